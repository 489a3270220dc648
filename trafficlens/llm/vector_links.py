"""Near copies of embeddings by hierarchical navigable small-world graphs, one a shard.

Vectors of one label are dealt by hash into shards of a bounded size. A task builds the graph of a
shard. A vector that is very close to a vertex of the graph joins that vertex's ball instead of
becoming one, so a group of thousands of copies is a few vertices. Then every two shards of a label
meet: each ball of the one queries the graph of the other, with a threshold that no link between two
balls can fall below (angles add up), and the members of balls that may link are compared by one
matrix product in double precision. A query's beam goes on, twice as wide, while all of it is near
enough; each meeting audits itself against a full scan for some of its vectors, widens the beam until
enough of their links are found, and compares all with all where no beam suffices. Balls hang together
by their vertex, so one link for two balls that link at all is what unites components; links are
counted, from both sides of a meeting at once.
"""

import heapq
import pickle

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, mixed, stored

COSINE = 0.93
#: Vectors in a shard at most, on average.
SHARD = 8192
#: Neighbours of a vertex (twice as many on the lowest level), beam of the build, first beam of queries.
DEGREE, BUILD_BEAM, BEAM = 10, 24, 16
#: How close a vector is to the vertex whose ball it joins: at least so, and closer than a link.
BALL = 0.97
#: Vectors of a shard that are audited in each meeting (all if fewer), the share of links to be found.
AUDITED, RECALL = 64, 0.99
#: Rows of one matrix product.
ROWS = 1024
_SLACK = 1e-7


class SmallWorld:
    """One graph: rows of unit vectors; for each level a list of neighbours of every vertex; for
    every row the vertex whose ball it is in (its own, if it is one)."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray, ball: float = BALL):
        self.vectors, self.ball = vectors, ball
        self.levels = [dict()]
        self.entry, self.highest = 0, 0
        self.owner = np.arange(len(ids))
        # levels are drawn by the ids' hash, so a rebuilt graph is the same graph
        draw = (mixed(ids.astype(np.int64).view(np.uint64)) >> np.uint64(11)) / 2.0**53
        top = np.floor(-np.log(np.maximum(draw, 1e-300)) / np.log(DEGREE)).astype(int)
        for row in range(len(ids)):
            self._insert(row, int(top[row]))
        # members of each ball, and the angle that it reaches
        order = np.argsort(self.owner, kind="stable")
        self.vertices, first = np.unique(self.owner[order], return_index=True)
        self.members = dict(zip(self.vertices.tolist(), np.split(order, first[1:]), strict=True)) if len(order) else {}
        near = np.einsum("ij,ij->i", vectors, vectors[self.owner])
        angle = np.where(self.owner == np.arange(len(ids)), 0.0, np.arccos(np.clip(near, -1, 1)) + _SLACK)
        self.radius = np.zeros(len(ids))
        np.maximum.at(self.radius, self.owner, angle)

    def _insert(self, row: int, top: int) -> None:
        if row == 0:
            self.levels = [{0: []} for _ in range(top + 1)]
            self.highest = top
            return
        query, near, found = self.vectors[row], [self.entry], {}
        for k in range(self.highest, -1, -1):
            found[k] = self._beam(query, near, k, BUILD_BEAM if k <= top else 1)
            near = [i for _, i in found[k]]
        if found[0][0][0] >= self.ball:
            self.owner[row] = found[0][0][1]
            return
        while len(self.levels) <= top:
            self.levels.append({})
        for k in range(top + 1):
            level = self.levels[k]
            if k > self.highest:
                level[row] = []
                continue
            degree = DEGREE if k else 2 * DEGREE
            level[row] = self._diverse(found[k], DEGREE)
            for other in level[row]:
                back = level[other]
                back.append(row)
                if len(back) > degree + degree // 2:
                    sims = self.vectors[back] @ self.vectors[other]
                    level[other] = self._diverse(sorted(zip(sims.tolist(), back, strict=True), reverse=True), degree)
        if top > self.highest:
            self.entry, self.highest = row, top

    def _diverse(self, found, degree: int) -> list[int]:
        """The best of ``found`` (similarity, row; best first) that aren't closer to a chosen one.

        Places that stay open go to the best that were passed over.
        """
        if len(found) <= degree:
            return [i for _, i in found]
        rows = [i for _, i in found]
        vectors = self.vectors[rows]
        among = vectors @ vectors.T
        closest = np.full(len(rows), -2.0)  # to any that is chosen
        chosen, passed = [], []
        for k, (sim, _) in enumerate(found):
            if len(chosen) == degree:
                break
            if closest[k] > sim:
                passed.append(k)
            else:
                chosen.append(k)
                np.maximum(closest, among[k], out=closest)
        return [rows[k] for k in (chosen + passed)[:degree]]

    def _beam(self, query, start, k: int, width: int) -> list[tuple[float, int]]:
        """The best ``width`` rows that a beam search of level ``k`` finds, best first."""
        level = self.levels[k]
        seen = set(start)
        sims = (self.vectors[start] @ query).tolist()
        todo = [(-s, i) for s, i in zip(sims, start, strict=True)]
        heapq.heapify(todo)
        best = [(s, i) for s, i in zip(sims, start, strict=True)]
        heapq.heapify(best)
        while len(best) > width:
            heapq.heappop(best)
        while todo:
            s, i = heapq.heappop(todo)
            if len(best) >= width and -s < best[0][0]:
                break
            new = [j for j in level[i] if j not in seen]
            if not new:
                continue
            seen.update(new)
            for s, j in zip((self.vectors[new] @ query).tolist(), new, strict=True):
                if len(best) < width:
                    heapq.heappush(best, (s, j))
                    heapq.heappush(todo, (-s, j))
                elif s > best[0][0]:
                    heapq.heapreplace(best, (s, j))
                    heapq.heappush(todo, (-s, j))
        return sorted(best, reverse=True)

    def similar(self, query, least: float, beam: int) -> list[int]:
        """Vertices of similarity ``least`` or more; while the whole beam is, the search goes on with
        one twice as wide from what it has seen."""
        near = [self.entry]
        for k in range(self.highest, 0, -1):
            near = [self._beam(query, near, k, 1)[0][1]]
        level = self.levels[0]
        sims = {near[0]: float(self.vectors[near[0]] @ query)}
        todo = [(-sims[near[0]], near[0])]
        best = [(sims[near[0]], near[0])]
        while True:
            while todo:
                s, i = heapq.heappop(todo)
                if len(best) >= beam and -s < best[0][0]:
                    heapq.heappush(todo, (s, i))
                    break
                new = [j for j in level[i] if j not in sims]
                if not new:
                    continue
                for s, j in zip((self.vectors[new] @ query).tolist(), new, strict=True):
                    sims[j] = s
                    heapq.heappush(todo, (-s, j))
                    if len(best) < beam:
                        heapq.heappush(best, (s, j))
                    elif s > best[0][0]:
                        heapq.heapreplace(best, (s, j))
            if not todo or best[0][0] < least:
                return [j for j, s in sims.items() if s >= least]
            beam *= 2
            best = heapq.nlargest(beam, ((s, j) for j, s in sims.items()))
            heapq.heapify(best)


class Meeting:
    """Links between the rows of two graphs (or of one), found through the balls of both."""

    def __init__(self, a: SmallWorld, b: SmallWorld, least: float):
        self.a, self.b, self.least = a, b, least
        self.theta = float(np.arccos(least)) + _SLACK
        self.exact = False
        self.audited = self.found = 0
        beam = BEAM
        while True:
            self.pairs = self._near(a, b, beam)
            if a is not b:
                self.pairs |= {(i, j) for j, i in self._near(b, a, beam)}
            else:
                self.pairs |= {(j, i) for i, j in self.pairs} | {(i, i) for i in a.vertices.tolist()}
            if self._enough():
                return
            if beam >= max(len(a.vertices), len(b.vertices)):
                # no beam finds enough: all balls meet all
                self.exact = True
                self.found = self.audited
                return
            beam *= 2

    def _near(self, of: SmallWorld, to: SmallWorld, beam: int) -> set[tuple[int, int]]:
        """Pairs of vertices whose balls may hold a link."""
        found, widest = set(), float(to.radius.max(initial=0.0))
        for i in of.vertices.tolist():
            reach = self.theta + of.radius[i]
            near = np.array(to.similar(of.vectors[i], float(np.cos(min(np.pi, reach + widest))), beam), dtype=np.int64)
            if len(near):
                angle = np.arccos(np.clip(to.vectors[near] @ of.vectors[i], -1, 1))
                found.update((i, j) for j in near[angle <= reach + to.radius[near]].tolist())
        return found

    def _enough(self) -> bool:
        """Whether the pairs hold enough of the links that some rows truly have, other than with themselves."""
        self.audited = self.found = 0
        for a, b, turned in ((self.a, self.b, False), (self.b, self.a, True)):
            rows = np.unique(np.linspace(0, len(a.vectors) - 1, min(len(a.vectors), AUDITED)).astype(int))
            at, other = np.nonzero(a.vectors[rows] @ b.vectors.T >= self.least)
            at = rows[at]
            if a is b:
                at, other = at[at != other], other[at != other]
            balls = zip(a.owner[at].tolist(), b.owner[other].tolist(), strict=True)
            self.audited += len(at)
            self.found += sum(((j, i) if turned else (i, j)) in self.pairs for i, j in balls)
        return self.found >= RECALL * self.audited

    def links(self, copies_a: np.ndarray, copies_b: np.ndarray):
        """Links of every row of either side, with copies counted, and one (row a, row b) of every two
        balls that link; the members of a ball link with its vertex."""
        a, b = self.a, self.b
        of_a, of_b, ties = np.zeros(len(a.vectors), dtype=np.int64), np.zeros(len(b.vectors), dtype=np.int64), []
        if self.exact:
            everything = np.arange(len(b.vectors))
            groups = {i: [everything] for i in a.vertices.tolist()}
        else:
            groups = {}
            for i, j in sorted(self.pairs):
                groups.setdefault(i, []).append(b.members[j])
        for i, parts in groups.items():
            right = np.concatenate(parts)
            for at in range(0, len(a.members[i]), ROWS):
                left = a.members[i][at : at + ROWS]
                for to in range(0, len(right), 8 * ROWS):
                    others = right[to : to + 8 * ROWS]
                    near = a.vectors[left] @ b.vectors[others].T >= self.least
                    if a is b:
                        near &= left[:, None] != others
                    of_a[left] += near @ copies_b[others]
                    if a is not b:
                        of_b[others] += copies_a[left] @ near
                    some = near.any(axis=0).nonzero()[0]
                    _, first = np.unique(b.owner[others[some]], return_index=True)
                    ties += [(int(left[near[:, some[k]].argmax()]), int(others[some[k]])) for k in first.tolist()]
        return of_a, of_b, ties


def usable_vectors(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, x) of the rows that can link, x as doubles."""
    x = F.col("embedding").cast("array<double>")
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists(x, lambda c: c != 0)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", x.alias("x"))
    return rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("x").isNotNull() & F.coalesce(fine, F.lit(False)))


def _unit(column, dims: int) -> np.ndarray:
    x = np.asarray(column.combine_chunks().flatten().to_numpy()).reshape(-1, dims)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


FOUND = "cls long, links long, other long, audited long, found long"


def _graphs(shards: DataFrame, ball: float) -> DataFrame:
    """(label, dims, shard, shards, graph): the graph of every shard."""

    def rows(key, table):
        import pyarrow as pa

        table = table.sort_by("cls")
        ids = table.column("cls").to_numpy()
        world = SmallWorld(_unit(table.column("x"), key[1].as_py()), ids, ball)
        graph = pickle.dumps((world.__dict__, ids, table.column("copies").to_numpy()), protocol=5)
        number = table.column("shards").slice(0, 1).combine_chunks()
        return pa.table([*(pa.array([k.as_py()], k.type) for k in key), number, pa.array([graph], pa.binary())],
                        names=["label", "dims", "shard", "shards", "graph"])

    kind = shards.schema["label"].dataType.simpleString()
    return shards.groupBy("label", "dims", "shard").applyInArrow(
        rows, f"label {kind}, dims int, shard long, shards long, graph binary"
    )


def _loaded(graph: bytes):
    state, ids, copies = pickle.loads(graph)
    world = SmallWorld.__new__(SmallWorld)
    world.__dict__.update(state)
    return world, ids, copies


def _met(graphs: DataFrame, least: float) -> DataFrame:
    """FOUND of every two shards of a label (and of each with itself): links of the vectors, ties
    between balls, and what the audits found."""

    def rows(key, left, right):
        import pyarrow as pa

        schema = pa.schema([(c.split()[0], pa.int64()) for c in FOUND.split(", ")])
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        a, ids_a, copies_a = _loaded(left.column("graph")[0].as_py())
        same = key[2].as_py() == key[3].as_py()
        b, ids_b, copies_b = (a, ids_a, copies_a) if same else _loaded(right.column("graph")[0].as_py())
        meeting = Meeting(a, b, least)
        of_a, of_b, ties = meeting.links(copies_a, copies_b)
        cls, links, other = [ids_a], [of_a], [np.full(len(ids_a), -1)]
        if same:
            # a ball hangs together by its vertex
            inner = np.flatnonzero(a.owner != np.arange(len(ids_a)))
            ties += list(zip(a.owner[inner].tolist(), inner.tolist(), strict=True))
        else:
            cls, links, other = [*cls, ids_b], [*links, of_b], [*other, np.full(len(ids_b), -1)]
        ends = np.array(ties, dtype=np.int64).reshape(-1, 2)
        cls += [ids_a[ends[:, 0]], [0]]
        links += [np.zeros(len(ends), dtype=np.int64), [0]]
        other += [ids_b[ends[:, 1]], [0]]
        n, tied = sum(map(len, cls)), len(ends)
        whole = [np.concatenate(c).astype(np.int64) for c in (cls, links, other)]
        kind = np.zeros(n, dtype=np.int8)  # 0: links of a vector, 1: a tie, 2: the audit
        kind[n - 1 - tied :] = 1
        kind[-1] = 2
        audit = [np.where(kind == 2, v, 0) for v in (meeting.audited, meeting.found)]
        columns = [
            pa.array(whole[0], mask=kind == 2), pa.array(whole[1], mask=kind != 0), pa.array(whole[2], mask=kind != 1),
            *(pa.array(v, mask=kind != 2) for v in audit),
        ]
        return pa.table(columns, schema=schema)

    # shard i meets shard j >= i
    numbers = F.sequence(F.lit(0).cast("long"), F.col("shards") - 1)
    left = graphs.withColumn("to", F.explode(F.filter(numbers, lambda j: j >= F.col("shard"))))
    right = graphs.withColumn("of", F.explode(F.filter(numbers, lambda j: j <= F.col("shard"))))
    left = left.select("label", "dims", F.col("shard").alias("of"), "to", "graph")
    right = right.select("label", "dims", "of", F.col("shard").alias("to"), "graph")
    keys = ["label", "dims", "of", "to"]
    left, right = left.toDF(*left.columns), right.toDF(*right.columns)
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(rows, FOUND)


def _classes(rows: DataFrame) -> DataFrame:
    """Equal vectors of a label as one class, named by its smallest id, and its shard."""
    classes = rows.groupBy("label", "x").agg(F.min("vec_id").alias("cls"), F.count("*").alias("copies"), F.first("dims").alias("dims"))
    sizes = classes.groupBy("label", "dims").agg(F.ceil(F.count("*") / SHARD).alias("shards"))
    return classes.join(sizes, ["label", "dims"]).withColumn("shard", F.pmod(F.xxhash64("cls"), F.col("shards")))


def audits(found: DataFrame) -> DataFrame:
    """(audited, found, recall) of every meeting of two shards, of the table ``linked_vectors`` stores."""
    return found.where("audited is not null").select("audited", "found", (F.col("found") / F.greatest("audited", F.lit(1))).alias("recall"))


def found_links(vectors: DataFrame, least: float = COSINE):
    """(rows, classes, FOUND) behind ``linked_vectors``, stored."""
    rows = stored(usable_vectors(vectors).withColumn("dims", F.size("x")), "vectors")
    classes = stored(_classes(rows), "classes")
    shards = classes.select("label", "dims", "shard", "shards", "cls", "copies", "x")
    graphs = stored(_graphs(shards, max(BALL, (least + 1) / 2)), "graphs")
    return rows, classes, stored(_met(graphs, least), "found")


def linked_vectors(vectors: DataFrame, least: float = COSINE) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of ``vectors`` (vec_id, embedding, label).

    Vectors link when their labels are equal and not null and their cosine is ``least`` or more.
    Null or zero vectors, and those with null or non-finite components, link with nothing, nor do
    rows with a null id (their component is null, kept false). Equal vectors are searched once and
    counted as often as they occur. Rows with one id are one node. Vectors of different length
    never link. Other columns are left aside. An empty table gives no rows.
    """
    rows, classes, found = found_links(vectors, least)
    links = found.where("links is not null").groupBy("cls").agg(F.sum("links").alias("links"))
    members = rows.join(classes.select("label", "x", "cls", "copies"), ["label", "x"]).select("vec_id", "cls", "copies")
    of = components(
        found.where("other is not null").select(F.col("cls").alias("a"), F.col("other").alias("b")).union(members.select("vec_id", "cls")), "a", "b"
    )
    n = members.join(links, "cls", "left").groupBy("vec_id").agg(F.sum(F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    out = vectors.select(F.col("vec_id").cast("long").alias("vec_id"))
    out = out.join(n, "vec_id", "left").join(of.withColumnRenamed("node", "vec_id"), "vec_id", "left")
    component = F.coalesce("component", "vec_id")
    return out.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"),
    )
