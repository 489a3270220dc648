"""SentencePiece encoding and decoding that keeps, for every piece, its bytes in the source text.

A text is normalised from left to right: at each place the longest prefix that the model's compiled
character map holds is replaced, any other character stays, and every normalised byte remembers the
source byte it came from. The normalised text is cut where no piece of the vocabulary reaches across,
frequent parts are looked up, and the lengths of the pieces, added up, lead through the remembered
places back to a span of the source.
"""

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _BYTE, _powers, mixed, once_per_worker, text_batches

#: The sign that stands for a blank in pieces, and the sign for what is no character.
BLANK = "▁"
_BLANK, _BROKEN = BLANK.encode(), "�".encode()
#: Parts whose ids a worker remembers at most, and parts that are encoded in one text.
REMEMBERED, TOGETHER = 500_000, 200
#: Kinds of pieces in a model file.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, BYTE = 1, 2, 3, 4, 6


def _number(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        at, value, shift = at + 1, value | (byte & 127) << shift, shift + 7
        if byte < 128:
            return value, at


def _fields(data: bytes):
    """(number, value) of the fields of a protocol buffer message."""
    at = 0
    while at < len(data):
        tag, at = _number(data, at)
        if tag & 7 == 0:
            value, at = _number(data, at)
        else:
            size, at = _number(data, at) if tag & 7 == 2 else ((4, at) if tag & 7 == 5 else (8, at))
            value, at = data[at : at + size], at + size
        yield tag >> 3, value


def _field(number: int, value) -> bytes:
    out = bytearray()
    for x in (number << 3 | 2, len(value)) if isinstance(value, bytes) else (number << 3, value):
        while x > 127:
            out.append(x & 127 | 128)
            x >>= 7
        out.append(x)
    return bytes(out) + (value if isinstance(value, bytes) else b"")


class CharacterMap:
    """The compiled character map: a double array over UTF-8 bytes and the replacements."""

    def __init__(self, blob: bytes):
        size = int.from_bytes(blob[:4], "little")
        self.units = np.frombuffer(blob[4 : 4 + size], dtype="<u4").tolist()
        self.texts = blob[4 + size :]
        # by the first two bytes: may a rule begin so
        self.may = np.zeros((256, 256), dtype=bool)
        if self.units:
            for first in range(256):
                at, leaf = self._step(self._offset(self.units[0]), first)
                if at is not None:
                    self.may[first] = leaf or [self._step(at, second)[0] is not None for second in range(256)]

    @staticmethod
    def _offset(unit: int) -> int:
        return (unit >> 10) << ((unit & 512) >> 6)

    def _step(self, at: int, byte: int):
        """The place after ``byte`` (None: no such path), and whether a rule ends there."""
        unit = self.units[at ^ byte]
        if unit & 0x800000FF != byte:
            return None, False
        return at ^ byte ^ self._offset(unit), bool(unit >> 8 & 1)

    def longest(self, text: bytes, start: int):
        """(length, replacement) of the longest rule that fits at ``start``, or None."""
        at, found = self._offset(self.units[0]), None
        for i in range(start, len(text)):
            at, leaf = self._step(at, text[i])
            if at is None:
                break
            if leaf:
                found = i + 1 - start, self.units[at] & 0x7FFFFFFF
        if found is None:
            return None
        return found[0], self.texts[found[1] : self.texts.index(b"\0", found[1])]


class PieceModel:
    """A SentencePiece BPE model with byte fallback, by its file or its bytes."""

    def __init__(self, path: str | None = None, proto: bytes | None = None):
        import sentencepiece

        if proto is None:
            with open(path, "rb") as file:
                proto = file.read()
        self.library = sentencepiece.SentencePieceProcessor(model_proto=proto)
        pieces, rules, plain, trainer = [], {}, [], {}
        for number, value in _fields(proto):
            if number == 1:
                piece = dict(_fields(value))
                pieces.append((piece[1].decode(), piece.get(3, NORMAL)))
            if number == 3:
                rules = dict(_fields(value))
            if number == 2:
                trainer = dict(_fields(value))
            if number != 3:
                plain.append(_field(number, value))
        # the library on texts that are normalised already
        plain.append(_field(3, b"".join(_field(k, 0) for k in (3, 4, 5))))
        self.plain = sentencepiece.SentencePieceProcessor(model_proto=b"".join(plain))
        kinds = np.array([k for _, k in pieces])
        if not (kinds == BYTE).any() or (kinds == USER_DEFINED).any() or trainer.get(3) != 2 or trainer.get(24):
            raise ValueError("a BPE model with byte pieces and without user-defined ones is needed")
        blob = rules.get(2, b"")
        self.map = CharacterMap(blob) if blob else None
        self.prefix, self.squeeze, self.escape = (bool(rules.get(k, 1)) for k in (3, 4, 5))
        self.is_byte = kinds == BYTE
        own = (kinds != UNKNOWN) & (kinds != CONTROL)
        normal = [p for (p, _), k, o in zip(pieces, kinds, own, strict=True) if o and k != BYTE]
        self.sizes = np.array([1 if k == BYTE else len(p.encode()) for p, k in pieces]) * own
        # the bytes that each piece stands for, none for control pieces
        out = [bytes([int(p[3:5], 16)]) if k == BYTE else p.replace(BLANK, " ").encode() for p, k in pieces]
        self.out_sizes = np.array([len(p) for p in out]) * own
        self.out_firsts = np.cumsum([0] + [len(p) for p in out[:-1]])
        self.out_bytes = np.frombuffer(b"".join(out), dtype=np.uint8)
        self.begin, self.end = self.library.bos_id(), self.library.eos_id()
        # parts: before a blank sign nothing reaches across, nor around characters that no piece holds
        self.cuts = not any(re.search(f"[^{BLANK}]{BLANK}", p) for p in normal)
        self.alone = np.zeros(256, dtype=bool)
        self.alone[[ord(c) for c in "\n\t\r" if not any(c in p for p in normal)]] = True
        self._forget()

    # --- normalising -------------------------------------------------------------------------

    def normalised(self, text: bytes) -> tuple[bytes, np.ndarray]:
        """The normalised text, and the source place of each of its bytes (and of its end)."""
        data = np.frombuffer(text, dtype=np.uint8)
        places = np.arange(len(data), dtype=np.int64)
        starts = (data & 0xC0) != 0x80
        edits = self._edits(text, data, starts)
        places = np.maximum.accumulate(np.where(starts, places, 0)) if len(data) else places
        if edits:
            bytes_of, places_of, last = [], [], 0
            for at, size, new in edits:
                bytes_of += [data[last:at], np.frombuffer(new, dtype=np.uint8)]
                places_of += [places[last:at], np.full(len(new), at)]
                last = at + size
            data = np.concatenate([*bytes_of, data[last:]])
            places = np.concatenate([*places_of, places[last:]])
        end, first = len(text), 0
        if self.squeeze and len(data):
            blank = data == 32
            keep = ~blank
            keep[1:] |= blank[1:] & ~blank[:-1]
            data, places = data[keep], places[keep]
            first = int(places[0]) if len(places) else end
        if not len(data):
            return b"", np.array([end])
        if self.prefix:
            data, places = np.concatenate([[np.uint8(32)], data]), np.concatenate([[first], places])
        if self.escape:
            data, places = _escaped(data, places)
        whole = data.tobytes()
        if self.squeeze:
            sign = _BLANK if self.escape else b" "
            size = len(whole)
            while whole.endswith(sign, 0, size):
                size -= len(sign)
                end = int(places[size])
            whole, places = whole[:size], places[:size]
        return whole, np.append(places, end)

    def _edits(self, text: bytes, data: np.ndarray, starts: np.ndarray) -> list[tuple[int, int, bytes]]:
        """(place, length, replacement) of all that changes, from left to right."""
        broken = not _is_text(text)
        if self.map is None and not broken:
            return []
        found, last = [], 0
        if not broken:
            after = np.append(data[1:], np.uint8(0))
            places = np.flatnonzero(starts & self.map.may[data, after]).tolist()
        else:
            places = range(len(text))
        for at in places:
            if at < last:
                continue
            rule = self.map.longest(text, at) if self.map else None
            if rule:
                found.append((at, *rule))
                last = at + rule[0]
            elif broken:
                size = next((n for n in range(1, 5) if _is_character(text[at : at + n])), 0)
                if not size:
                    found.append((at, 1, _BROKEN))
                last = at + max(size, 1)
        return found

    def _batch(self, texts: list[bytes]):
        """Normalised bytes of all texts, source place of each, and where a text ends in both."""
        sizes = np.array([len(t) for t in texts], dtype=np.int64)
        if self.map is None and not self.squeeze and self.prefix and self.escape and _is_text(b"".join(texts)):
            data = np.frombuffer(b"".join([b" " + t for t in texts if t]), dtype=np.uint8)
            lengths = sizes + (sizes > 0)
            places = np.maximum.accumulate(np.where((data & 0xC0) != 0x80, np.arange(len(data)), 0))
            places = np.maximum(places - np.repeat(np.cumsum(lengths) - lengths + 1, lengths), 0)
            blanks = np.concatenate([[0], np.cumsum(data == 32)])
            ends = np.cumsum(lengths)
            return *_escaped(data, places), ends + 2 * blanks[ends], sizes
        both = [self.normalised(t) for t in texts]
        data = np.frombuffer(b"".join(n for n, _ in both), dtype=np.uint8)
        places = np.concatenate([p[:-1] for _, p in both]) if both else np.zeros(0, dtype=np.int64)
        return data, places, np.cumsum([len(n) for n, _ in both]), np.array([p[-1] for _, p in both], dtype=np.int64)

    # --- encoding ----------------------------------------------------------------------------

    def encode(self, text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of a text, without begin and end ids, and begins and ends of their source bytes."""
        return self.encode_batch([text])[:3]

    def encode_batch(self, texts: list[bytes]):
        """Ids of all texts in a row, begins and ends of their bytes in their text, bounds of texts.

        Of the byte pieces of one character the last has its bytes, the others an empty span.
        """
        data, places, tops, sources = self._batch(texts)
        ids = self._ids(data, np.concatenate([[0], tops[:-1]]) if len(tops) else tops)
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes)
        begins = ends - sizes
        bounds = np.concatenate([[0], np.searchsorted(ends, tops, side="right")])
        first, last = places[begins], np.append(places, 0)[ends]
        has = np.diff(bounds) > 0
        last[bounds[1:][has] - 1] = sources[has]
        small = self.is_byte[ids]
        if small.any():
            inner = small & ((np.append(data, np.uint8(0))[ends] & 0xC0) == 0x80)
            last[inner] = first[inner]
        return ids, first, last, bounds

    def _ids(self, data: np.ndarray, heads: np.ndarray) -> np.ndarray:
        """Ids of normalised texts that begin at ``heads``; known parts are looked up by hash."""
        n = len(data)
        if not n:
            return np.zeros(0, dtype=np.int64)
        cut = np.zeros(n, dtype=bool)
        cut[heads[heads < n]] = True
        if self.cuts:
            blank = np.zeros(n, dtype=bool)
            if n > 2:
                blank[:-2] = (data[:-2] == _BLANK[0]) & (data[1:-1] == _BLANK[1]) & (data[2:] == _BLANK[2])
            run = blank.copy()
            run[3:] &= ~blank[:-3]
            alone = self.alone[data]
            cut |= run | alone
            cut[1:] |= alone[:-1]
        starts = np.flatnonzero(cut)
        ends = np.append(starts[1:], n)
        up, down = _powers(n + 1)
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(_BYTE[data] * up[:n], out=sums[1:])
        hashes = mixed((sums[ends] - sums[starts]) * down[starts])
        unique, one, place = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.hashes) > REMEMBERED:
            self._forget()
        at = np.searchsorted(self.hashes, unique)
        new = np.ones(len(unique), dtype=bool)
        inside = at < len(self.hashes)
        new[inside] = self.hashes[at[inside]] != unique[inside]
        if new.any():
            whole = data.tobytes()
            self._add(unique[new], at[new], [whole[i:j] for i, j in zip(starts[one[new]].tolist(), ends[one[new]].tolist(), strict=True)])
        row = self.rows[np.searchsorted(self.hashes, unique)][place]
        return _gathered(self.flat, self.firsts[row], self.counts[row])

    def _forget(self) -> None:
        self.hashes = np.zeros(0, dtype=np.uint64)
        self.rows = self.firsts = self.counts = self.flat = np.zeros(0, dtype=np.int64)

    def _add(self, hashes: np.ndarray, at: np.ndarray, parts: list[bytes]) -> None:
        """Put new parts with their ids in the order of hashes.

        Parts that begin with a blank sign and end with another are encoded many in one text: as
        nothing reaches across, the lengths of the pieces tell the parts apart.
        """
        joins = [self.cuts and p.startswith(_BLANK) and not p.endswith(_BLANK) and len(p) < 256 for p in parts]
        joint = [k for k, j in enumerate(joins) if j]
        texts = [b"".join([parts[k] for k in joint[i : i + TOGETHER]]).decode() for i in range(0, len(joint), TOGETHER)]
        ids = np.array([x for t in self.plain.encode(texts, num_threads=1) for x in t], dtype=np.int64)
        tops = np.cumsum([len(parts[k]) for k in joint], dtype=np.int64)
        edges = np.searchsorted(np.cumsum(self.sizes[ids]), tops, side="right")
        counts, order = np.diff(edges, prepend=0), list(joint)
        others = [k for k, j in enumerate(joins) if not j]
        if others:
            each = self.plain.encode([parts[k].decode() for k in others], num_threads=1)
            counts = np.concatenate([counts, [len(x) for x in each]])
            ids = np.concatenate([ids, np.array([i for x in each for i in x], dtype=np.int64)])
            order += others
        row = np.empty(len(parts), dtype=np.int64)
        row[order] = np.arange(len(parts))
        self.hashes = np.insert(self.hashes, at, hashes)
        self.rows = np.insert(self.rows, at, len(self.counts) + row)
        self.firsts = np.concatenate([self.firsts, len(self.flat) + np.cumsum(counts) - counts])
        self.counts = np.concatenate([self.counts, counts])
        self.flat = np.concatenate([self.flat, ids])

    # --- decoding ----------------------------------------------------------------------------

    def decode(self, ids: np.ndarray) -> bytes:
        """The UTF-8 of the library's decode of the ids."""
        return self.decode_batch(np.asarray(ids, dtype=np.int64), np.array([0, len(ids)]))[0]

    def decode_batch(self, ids: np.ndarray, bounds: np.ndarray) -> list[bytes]:
        """The same of many runs of ids; ids that are no whole characters go to the library."""
        sizes = self.out_sizes[ids]
        whole = _gathered(self.out_bytes, self.out_firsts[ids], sizes).tobytes()
        if self.squeeze or not self.prefix or not _is_text(whole):
            return [self.library.decode(ids[a:b].tolist()).encode() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        edges = np.concatenate([[0], np.cumsum(sizes)])[bounds].tolist()
        out = []
        for a, b, i, j in zip(edges[:-1], edges[1:], bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            while i < j and not sizes[i]:
                i += 1
            dropped = i < j and not self.is_byte[ids[i]] and whole[a : a + 1] == b" "
            out.append(whole[a + dropped : b])
        return out


def _escaped(data: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Blanks become the blank sign, of three bytes with one place."""
    blank = np.flatnonzero(data == 32)
    times = np.ones(len(data), dtype=np.int64)
    times[blank] = 3
    at = blank + 2 * np.arange(len(blank))
    out = np.repeat(data, times)
    for k, byte in enumerate(_BLANK):
        out[at + k] = byte
    return out, np.repeat(places, times)


def _gathered(flat: np.ndarray, firsts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """flat[first : first + count] of every row, one after the other."""
    ends = np.cumsum(counts)
    if not len(ends):
        return flat[:0]
    return flat[np.arange(ends[-1]) + np.repeat(firsts - ends + counts, counts)]


def _is_text(data: bytes) -> bool:
    try:
        data.decode()
        return True
    except UnicodeDecodeError:
        return False


def _is_character(data: bytes) -> bool:
    return _is_text(data) and len(data.decode()) == 1


def piece_model(path: str) -> PieceModel:
    return once_per_worker(("piece_model", path), lambda: PieceModel(path))


ENCODED = "doc_id long, n_tokens long, ids binary, begins binary, ends binary, decoded string"


def encoded_spans(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids, begins, ends, decoded of every row of ``docs``.

    ``ids`` are the ids of the whole text with the begin and the end id, as little-endian unsigned
    32-bit numbers; ``begins`` and ``ends``, packed alike, are the byte span of each in the text's
    UTF-8. The begin id has the empty span at 0, the end id that at the text's end. ``decoded`` is
    the library's decode of the ids. A null text is empty: it has the two ids only. Texts of any
    length are encoded whole. Repeated rows and null ids are kept as they are; other columns are
    left aside. An empty table gives no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def rows(batches):
        import pyarrow as pa

        model = piece_model(path)
        for batch in batches:
            for a, b, texts in text_batches(batch, "text"):
                ids, begins, ends, bounds = model.encode_batch(texts)
                packed = [[], [], []]
                for i, j, n in zip(bounds[:-1].tolist(), bounds[1:].tolist(), map(len, texts), strict=True):
                    packed[0].append(_wrapped(model.begin, ids[i:j], model.end))
                    packed[1].append(_wrapped(0, begins[i:j], n))
                    packed[2].append(_wrapped(0, ends[i:j], n))
                decoded = pa.array(model.decode_batch(ids, bounds), pa.binary()).cast(pa.string())
                columns = [pa.array(np.diff(bounds) + 2, pa.int64()), *(pa.array(c, pa.binary()) for c in packed), decoded]
                yield pa.record_batch([batch.column("doc_id").slice(a, b - a), *columns], names=_names(ENCODED))

    return docs.mapInArrow(rows, ENCODED)


def _wrapped(first: int, values: np.ndarray, last: int) -> bytes:
    return np.concatenate([[first], values, [last]]).astype("<u4").tobytes()


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


PIECES = "doc_id long, at long, id int, piece string, begin long, end long"


def piece_rows(encoded: DataFrame, path: str) -> DataFrame:
    """One row per piece of ``encoded_spans``: doc_id, at (from 0), id, piece, begin, end."""

    def rows(batches):
        import pyarrow as pa

        model = piece_model(path)
        names = [model.library.id_to_piece(i) for i in range(len(model.sizes))]
        for batch in batches:
            for k, doc in enumerate(batch.column("doc_id")):
                ids, begins, ends = (np.frombuffer(batch.column(c)[k].as_py(), dtype="<u4").astype(np.int64) for c in ("ids", "begins", "ends"))
                columns = [pa.repeat(doc, len(ids)), np.arange(len(ids)), ids.astype(np.int32), [names[i] for i in ids], begins, ends]
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.int64()]
                yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=_names(PIECES))

    return encoded.select("doc_id", "ids", "begins", "ends").mapInArrow(rows, PIECES)


def digests(encoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, spans_sha256 of ``encoded_spans``."""
    return encoded.select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
        F.sha2(F.concat("begins", "ends"), 256).alias("spans_sha256"),
    )
