"""BPE encoding and decoding with reuse of content-defined chunks.

A rolling hash over the bytes of a text cuts it where the hash of the last bytes has a fixed form,
so a passage that several documents hold is cut into the same chunks in all of them. Chunks that
occur more than once are encoded once, by one task, and their ids are handed to the documents that
hold them; other chunks are encoded where they are. Where two chunks meet, the ids may differ from
those of the whole text: a window around the join is encoded again, and widened until its ids agree
with the chunks' ids at both of its ends.
"""

import hashlib
import json
import os
import re
import unicodedata

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _BYTE, _powers, key_filter, maybe_in, mixed, once_per_worker, stored, text_batches, word_places
from .packing import _byte_of

#: Bytes that the rolling hash sees; mean, least and greatest size of a chunk.
WINDOW, MEAN, LEAST, MOST = 32, 2048, 256, 16_384
#: Words whose ids a worker remembers at most: of chunks, by hash, and around joins.
WORDS, REMEMBERED = 1_500_000, 50_000
#: Documents with shared chunks that one task puts together, on average.
TOGETHER = 512
#: Bytes of a document that one step of cutting works on.
STEP = 1 << 20


def cuts(text: bytes) -> list[int]:
    """Ends of the chunks of a text; every one begins with a whole character."""
    n = len(text)
    if n <= LEAST:
        return [n] if n else []
    data = np.frombuffer(text, dtype=np.uint8)
    found = []
    for at in range(0, n, STEP):
        part = data[max(0, at - WINDOW) : at + STEP]
        up, down = _powers(len(part) + 1)
        sums = np.zeros(len(part) + 1, dtype=np.uint64)
        np.cumsum(_BYTE[part] * up[: len(part)], out=sums[1:])
        if len(part) < WINDOW:
            break
        rolled = mixed((sums[WINDOW:] - sums[:-WINDOW]) * down[: len(part) - WINDOW + 1])
        ends = np.flatnonzero((rolled & np.uint64(MEAN - 1)) == 0) + WINDOW + max(0, at - WINDOW)
        found += ends.tolist()
    out, last = [], 0
    for end in [*found, n]:
        while end - last > MOST:
            last = _whole(data, last + MOST)
            out.append(last)
        end = _whole(data, end)
        if end - last >= LEAST or end == n > last:
            last = end
            out.append(end)
    return out


def _whole(data: np.ndarray, at: int) -> int:
    while at < len(data) and data[at] & 0xC0 == 0x80:
        at += 1
    return at


def chunk_name(chunk: bytes) -> bytes:
    return hashlib.blake2b(chunk, digest_size=16).digest()


class PlainWords:
    """The vocabulary of a tokenizers file run by a faster library, for words of Latin characters.

    Words are parted as the file's pattern says and each part gets a mark that stands for its end;
    then a pair is joined by the rank of the token it gives. That equals the file's list of pairs
    where every token is reached by its own pair, which ``of`` makes sure of.
    """

    MARK, BREAK, END = "\x01", "\n", "</w>"
    SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
    NORMAL = [
        {"type": "NFC"},
        {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "},
        {"type": "Lowercase"},
    ]

    @classmethod
    def of(cls, path: str):
        """For a file of the form it holds for, else None."""
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        steps = (spec["pre_tokenizer"] or {}).get("pretokenizers", [{}, {}])
        split = {"type": "Split", "pattern": {"Regex": cls.SPLIT}, "behavior": "Removed", "invert": True}
        bytewise = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": False}
        off = ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges")
        fits = (
            (spec["normalizer"] or {}).get("normalizers") == cls.NORMAL
            and len(steps) == 2
            and steps[0] == split
            and bytewise.items() <= steps[1].items()
            and model["type"] == "BPE"
            and model.get("end_of_word_suffix") == cls.END
            and not any(model.get(name) for name in off)
        )
        if not fits:
            return None
        special = {t["content"] for t in spec["added_tokens"]}
        vocab = {t: i for t, i in model["vocab"].items() if t not in special}
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        mark = next(c for c, b in _byte_of().items() if b == ord(cls.MARK))
        if any(len(t) > 1 and t.endswith(mark) for t in vocab):
            return None
        return cls(vocab) if cls._decided_by_tokens(vocab, pairs) else None

    @classmethod
    def _decided_by_tokens(cls, vocab: dict, pairs: list[tuple]) -> bool:
        """Whether ids rank the pairs, bytes come first, and the pairs build every token from its bytes."""
        single = [*_byte_of(), *(c + cls.END for c in _byte_of())]
        made = [vocab.get(a + b, -1) for a, b in pairs]
        if any(t not in vocab for t in single) or len(vocab) != len(single) + len(pairs):
            return False
        if made != sorted(set(made)) or (made and made[0] <= max(vocab[t] for t in single)):
            return False
        rank = {p: i for i, p in enumerate(pairs)}
        none = len(pairs)
        for a, b in pairs:
            whole = a + b
            inner = whole.removesuffix(cls.END)
            parts = [*inner[:-1], inner[-1:] + whole[len(inner) :]]
            while len(parts) > 1:
                k = min(range(len(parts) - 1), key=lambda i: rank.get((parts[i], parts[i + 1]), none))
                if (parts[k], parts[k + 1]) not in rank:
                    return False
                parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return True

    def __init__(self, vocab: dict):
        import tiktoken

        byte_of, mark = _byte_of(), self.MARK.encode()
        ranks = {}
        for token, i in vocab.items():
            inner = token.removesuffix(self.END)
            ranks[bytes(map(byte_of.__getitem__, inner)) + (mark if inner != token else b"")] = i
        self.break_id = ranks[self.BREAK.encode()]
        pattern = f"[^{self.MARK}{self.BREAK}]+{self.MARK}|{self.BREAK}"
        self.whole = tiktoken.Encoding("plain words", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        # below U+0250 characters are composed already, and lower case is one character each but for U+0130
        kinds = {"L": "", "N": "", "other": ""}
        for code in range(33, 0x250):
            c = chr(code)
            kind = unicodedata.category(c)[0]
            if kind not in "CZ" and len(c.lower()) == 1 and c.lower() < "\u0250":
                kinds[kind if kind in kinds else "other"] += c
        letters, numbers, others = (re.escape(k) for k in kinds.values())
        self.fits = re.compile(f"[{letters}{numbers}{others}]+").fullmatch
        self.parts = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{numbers}]|[{others}]+")

    def ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each word has, and the ids of all."""
        text = "".join(f"{w}{self.BREAK}" for w in words).lower()
        found = self.whole.encode_to_numpy(self.parts.sub(rf"\g<0>{self.MARK}", text), disallowed_special=())
        last = found == self.break_id
        ends = np.flatnonzero(last)
        return np.diff(ends, prepend=-1) - 1, found[~last]


class WordBpe:
    """A tokenizers file that takes A to Z as a to z and never joins what ASCII white space parts.

    Ids of chunks are put together from those of their words; a worker keeps words by 64-bit hash.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_padding()
        self.library.no_truncation()
        self.known = {}
        self.blank = re.compile("[ \n]+")
        if self._ids("AbC x") != self._ids("abc") + self._ids("X"):
            raise ValueError(f"{path} tells letter cases apart or joins words")
        self.special = [t.content.lower().encode() for t in self.library.get_added_tokens_decoder().values()]
        self.tokens = [self.library.id_to_token(i) for i in range(self.library.get_vocab_size())]
        self.ends = np.array([t.endswith("</w>") for t in self.tokens])
        self.plain = PlainWords.of(path)
        self._forget()

    def _ids(self, text: str) -> list[int]:
        return self.library.encode(text, add_special_tokens=False).ids

    def encode(self, text: str) -> list[int]:
        """Ids as the library gives them for the whole text; frequent words are looked up."""
        known, out, new = self.known, [], None
        words = self.blank.split(text)
        try:
            for w in words:
                out += known[w]
            return out
        except KeyError:
            new = list({w for w in words if w not in known})
        ids = dict(zip(new, (e.ids for e in self.library.encode_batch_fast(new, add_special_tokens=False)), strict=True))
        if len(known) < REMEMBERED:
            known.update((w, i) for w, i in ids.items() if len(w) < 40)
        out = []
        for w in words:
            out += known[w] if w in known else ids[w]
        return out

    def encode_batch(self, texts: list[bytes]) -> list[list[int]]:
        """Ids of many texts: their words are looked up by hash, all at once.

        Hashes take A to Z as a to z, special tokens don't: a text that may hold one goes by itself.
        """
        odd = {k: self.encode(t.decode()) for k, t in enumerate(texts) if any(s in t.lower() for s in self.special)}
        if odd:
            rest = iter(self.encode_batch([t for k, t in enumerate(texts) if k not in odd]))
            return [odd[k] if k in odd else next(rest) for k in range(len(texts))]
        whole, starts, ends, hashes, bounds = word_places(texts)
        unique, first, place = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.hashes) > WORDS:
            self._forget()
        at = np.searchsorted(self.hashes, unique)
        new = np.ones(len(unique), dtype=bool)
        inside = at < len(self.hashes)
        new[inside] = self.hashes[at[inside]] != unique[inside]
        if new.any():
            spans = zip(starts[first[new]].tolist(), ends[first[new]].tolist(), strict=True)
            self._add(unique[new], at[new], [whole[i:j].decode() for i, j in spans])
        row = self.rows[np.searchsorted(self.hashes, unique)][place]
        size = self.sizes[row]
        total = np.concatenate([[0], np.cumsum(size)])
        ids = self.flat[np.arange(total[-1]) + np.repeat(self.begins[row] - total[:-1], size)]
        edges = total[bounds].tolist()
        ids = ids.tolist()
        return [ids[i:j] for i, j in zip(edges[:-1], edges[1:], strict=True)]

    def _forget(self) -> None:
        self.hashes = np.zeros(0, dtype=np.uint64)
        self.rows = self.begins = self.sizes = np.zeros(0, dtype=np.int64)
        self.flat = np.zeros(0, dtype=np.uint32)

    def _add(self, hashes, at, words: list[str]) -> None:
        """Put new words with their ids in the order of hashes."""
        order, sizes, flat = self._word_ids(words)
        row = np.empty(len(words), dtype=np.int64)
        row[order] = len(self.sizes) + np.arange(len(words))
        self.hashes = np.insert(self.hashes, at, hashes)
        self.rows = np.insert(self.rows, at, row)
        self.begins = np.concatenate([self.begins, len(self.flat) + np.cumsum(sizes) - sizes])
        self.sizes = np.concatenate([self.sizes, sizes])
        self.flat = np.concatenate([self.flat, flat])

    def _word_ids(self, words: list[str]) -> tuple[list[int], np.ndarray, np.ndarray]:
        """An order of the words and, in it, how many ids each has and the ids of all."""
        if self.plain is None:
            easy = [k for k, w in enumerate(words) if w.lower().isalpha() and max(w) < "\u0250"]
            ids = self._latin([words[k] for k in easy])
            sizes, flat = [len(i) for i in ids], np.fromiter((i for of in ids for i in of), dtype=np.uint32)
        else:
            easy = [k for k, w in enumerate(words) if self.plain.fits(w)]
            sizes, flat = self.plain.ids([words[k] for k in easy])
        have = set(easy)
        other = [k for k in range(len(words)) if k not in have]
        ids = [e.ids for e in self.library.encode_batch_fast([words[k] for k in other], add_special_tokens=False)]
        sizes = np.concatenate([np.array(sizes, dtype=np.int64), np.array([len(i) for i in ids], dtype=np.int64)])
        return easy + other, sizes, np.concatenate([flat, np.fromiter((i for of in ids for i in of), dtype=np.uint32)])

    def _latin(self, words: list[str]) -> list[list[int]]:
        """Ids of words of Latin letters: encoded in one text, in which the file marks their ends."""
        if not words:
            return []
        ids = self.library.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids
        ends = (np.flatnonzero(self.ends[ids]) + 1).tolist()
        if len(ends) != len(words):
            return [e.ids for e in self.library.encode_batch_fast(words, add_special_tokens=False)]
        return [ids[i:j] for i, j in zip([0, *ends], ends, strict=False)]

    def decode(self, ids: list[int]) -> str:
        """The library's decode; a file without a decoder puts blanks between its tokens."""
        if self.library.decoder is None:
            return " ".join(map(self.tokens.__getitem__, ids))
        return self.library.decode(ids, skip_special_tokens=False)

    def joined(self, text: bytes, ends: list[int], ids: list) -> list[int]:
        """Ids of a whole text from those of its chunks, joins repaired."""
        if not ends:
            return []
        out, start = list(ids[0]), ends[0]
        for end, of in zip(ends[1:], ids[1:], strict=True):
            reach = 64
            while True:
                a, b = self._before(text, start, reach), self._after(text, start, end, reach)
                left, right = self.encode(text[a:start].decode()), self.encode(text[start:b].decode())
                edge = len(out) - len(left)
                if edge >= 0 and out[edge:] == left and list(of[: len(right)]) == right:
                    break
                reach *= 4
            both = self.encode(text[a:b].decode())
            out[edge:] = both
            out += of[len(right) :]
            start = end
        return out

    def _before(self, text: bytes, start: int, reach: int) -> int:
        """A place after a blank, at least ``reach`` bytes before ``start`` if there is one, or 0."""
        at = max(text.rfind(b" ", 0, max(0, start - reach)), text.rfind(b"\n", 0, max(0, start - reach)))
        near = [k for k in (text.rfind(b" ", 0, start), text.rfind(b"\n", 0, start)) if k >= 0]
        if reach == 64 and near and start - max(near) <= reach:
            return max(near) + 1
        return at + 1

    def _after(self, text: bytes, start: int, end: int, reach: int) -> int:
        """A place before a blank after ``start``, or the chunk's end."""
        near = [k for k in (text.find(b" ", start, end), text.find(b"\n", start, end)) if k >= 0]
        return min(near) if near else end


RESULT = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def _results(ids_of, doc_ids, bpe):
    import pyarrow as pa

    ids = [np.array(x, dtype="<u4") for x in ids_of]
    decoded = map(bpe.decode, ids_of)
    return pa.record_batch(
        {
            "doc_id": doc_ids,
            "n_tokens": pa.array([len(x) for x in ids], pa.int64()),
            "ids_sha256": pa.array([hashlib.sha256(x.tobytes()).hexdigest() for x in ids]),
            "decoded_sha256": pa.array([hashlib.sha256(x.encode()).hexdigest() for x in decoded]),
        }
    )


def _chunks(text: bytes):
    ends = cuts(text)
    return ends, [text[a:b] for a, b in zip([0, *ends], ends, strict=False)]


def _keys(names: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(n[:8] for n in names), dtype=np.int64)


def shared_chunks(docs: DataFrame) -> DataFrame:
    """(name, key) of the chunks that occur more than once in all texts."""

    def rows(batches):
        import pyarrow as pa

        for batch in batches:
            times = {}
            for _, _, texts in text_batches(batch, "text"):
                for text in texts:
                    for chunk in _chunks(text)[1]:
                        name = chunk_name(chunk)
                        times[name] = times.get(name, 0) + 1
            yield pa.record_batch({"name": pa.array(list(times), pa.binary()), "n": pa.array(list(times.values()), pa.int64())})

    sums = docs.select("text").mapInArrow(rows, "name binary, n long").groupBy("name").agg(F.sum("n").alias("n"))
    key = F.conv(F.hex(F.reverse(F.substring("name", 1, 8))), 16, -10).cast("long")
    return sums.where("n > 1").select("name", key.alias("key"))


def _encoded(docs: DataFrame, shared, path: str) -> DataFrame:
    """(name, ids) of the shared chunks, each encoded once."""

    def texts_of(batches):
        import pyarrow as pa

        for batch in batches:
            found = {}
            for _, _, texts in text_batches(batch, "text"):
                chunks = [c for t in texts for c in _chunks(t)[1]]
                names = [chunk_name(c) for c in chunks]
                for i in np.flatnonzero(maybe_in(shared.value, _keys(names))).tolist():
                    found[names[i]] = chunks[i]
            yield pa.record_batch({"name": pa.array(list(found), pa.binary()), "chunk": pa.array(list(found.values()), pa.binary())})

    def ids_of(batches):
        import pyarrow as pa

        bpe = once_per_worker(("word_bpe", path), lambda: WordBpe(path))
        for batch in batches:
            ids = [np.array(i, dtype="<u4").tobytes() for i in bpe.encode_batch(batch.column("chunk").to_pylist())]
            yield pa.record_batch({"name": batch.column("name"), "ids": pa.array(ids, pa.binary())})

    once = docs.select("text").mapInArrow(texts_of, "name binary, chunk binary").groupBy("name").agg(F.first("chunk").alias("chunk"))
    return once.select("name", "chunk").mapInArrow(ids_of, "name binary, ids binary")


def encoded_documents(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row of ``docs``.

    Ids are those that the tokenizers library gives for the whole text without special tokens of
    its own; the decoded text is that library's, special tokens kept. A null text is empty and has
    no ids. Repeated rows and null ids are kept as they are. Other columns are left aside. An
    empty table gives no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    names = stored(shared_chunks(docs), "shared")
    shared = docs.sparkSession.sparkContext.broadcast(key_filter(names, "key"))
    encoded = stored(_encoded(docs, shared, path), "encoded")

    def alone(batches):
        """Results of the documents without shared chunks."""
        bpe = once_per_worker(("word_bpe", path), lambda: WordBpe(path))
        for batch in batches:
            for a, _, texts in text_batches(batch, "text"):
                cut = [_chunks(t) for t in texts]
                own = [i for i, (_, c) in enumerate(cut) if not _any_shared(c)]
                of = iter(bpe.encode_batch([c for i in own for c in cut[i][1]]))
                ids = [bpe.joined(texts[i], cut[i][0], [next(of) for _ in cut[i][1]]) for i in own]
                yield _results(ids, batch.column("doc_id").take([a + i for i in own]) if own else batch.column("doc_id").slice(0, 0), bpe)

    def _any_shared(chunks):
        return bool(chunks) and bool(maybe_in(shared.value, _keys([chunk_name(c) for c in chunks])).any())

    def sharing(batches):
        """The other documents, and the names of their shared chunks."""
        import pyarrow as pa

        for batch in batches:
            for a, _, texts in text_batches(batch, "text"):
                at, names_of = [], []
                for i, t in enumerate(texts):
                    names = [chunk_name(c) for c in _chunks(t)[1]]
                    if names:
                        hit = np.flatnonzero(maybe_in(shared.value, _keys(names))).tolist()
                        if hit:
                            at.append(a + i)
                            names_of.append([names[k] for k in dict.fromkeys(hit)])
                take = pa.array(at, pa.int64())
                yield pa.record_batch(
                    {k: batch.column(k).take(take) for k in ("doc_id", "text")} | {"names": pa.array(names_of, pa.list_(pa.binary()))}
                )

    def together(key, texts, parts):
        bpe = once_per_worker(("word_bpe", path), lambda: WordBpe(path))
        import pyarrow as pa

        known = {n.as_py(): i.as_py() for n, i in zip(parts.column("name"), parts.column("ids"), strict=True)}
        out = []
        for text in texts.column("text").cast(pa.large_binary()):
            text = text.as_py()
            ends, chunks = _chunks(text)
            ids = [known.get(chunk_name(c)) for c in chunks]
            own = iter(bpe.encode_batch([c for c, have in zip(chunks, ids, strict=True) if have is None]))
            ids = [next(own) if have is None else np.frombuffer(have, dtype="<u4").tolist() for have in ids]
            out.append(bpe.joined(text, ends, ids))
        return pa.Table.from_batches([_results(out, texts.column("doc_id").combine_chunks(), bpe)])

    held = docs.mapInArrow(sharing, "doc_id long, text string, names array<binary>")
    groups = max(1, -(-docs.count() // (4 * TOGETHER)))
    held = held.withColumn("group", F.pmod(F.xxhash64("doc_id", "text"), F.lit(groups)))
    asked = held.select("group", F.explode("names").alias("name")).distinct()
    parts = asked.join(encoded, "name").select("group", "name", "ids")
    texts = held.select("doc_id", "text", "group")
    rest = texts.groupBy("group").cogroup(parts.toDF("group", "name", "ids").groupBy("group")).applyInArrow(together, RESULT)
    return docs.mapInArrow(alone, RESULT).unionByName(rest)
