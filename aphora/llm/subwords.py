"""Subword encoding that keeps offsets, and decoding, by a sentencepiece model (BPE with byte fallback).

A text is normalised through the model's compiled character map: at each place the longest rule that matches is applied, or
one character is kept, and every byte of the normalised text remembers where in the original text its source began.
White space becomes the model's space sign, with a sign in front if the model asks for one. Merging is left to the library,
which gets normalised text and a copy of the model without a normaliser, and only for stretches not seen before: no
piece reaches across a space sign that follows another character, nor across a character that no longer piece contains, so
stretches between such borders are encoded on their own and remembered. The lengths of the pieces, summed up, point into
the normalised text; the remembered places project each piece to a byte span of the original. A character without a
piece becomes byte pieces, the last of which has its span.

Null and empty texts have no pieces but the begin and end ids, and decode to an empty text. Rows keep their multiplicity,
an empty table gives an empty result, columns other than the carried ones are not read. Texts are worked on whole, about a
megabyte of them at once; the memory of a task is some 30 bytes per byte of its longest text.
"""

from __future__ import annotations

import codecs
import re
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aphora.llm.textmath import chunks, ragged

SPACE = "▁"
#: Characters of encoded stretches that a task remembers; beyond them only those of the latest megabyte are kept.
KNOWN = 1_000_000

# Kinds of pieces in a model file.
_NORMAL, _UNKNOWN, _CONTROL, _USER, _BYTE = 1, 2, 3, 4, 6


def _varint(data: bytes, at: int) -> tuple[int, int]:
    out = shift = 0
    while True:
        byte = data[at]
        at += 1
        out |= (byte & 0x7F) << shift
        shift += 7
        if byte < 0x80:
            return out, at


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """The fields of a protocol buffer message: number and value."""
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        kind = key & 7
        if kind == 0:
            value, at = _varint(data, at)
        else:
            size, at = _varint(data, at) if kind == 2 else ((8, at) if kind == 1 else (4, at))
            value, at = data[at : at + size], at + size
        yield key >> 3, value


class CharacterMap:
    """A compiled character map: rules in a double-array trie, and their replacements as texts that end in a zero byte."""

    def __init__(self, compiled: bytes) -> None:
        size = int.from_bytes(compiled[:4], "little")
        self.units = np.frombuffer(compiled, "<u4", size // 4, 4)
        self.texts = compiled[4 + size :]
        self.known: dict[int, np.ndarray] = {}

    @staticmethod
    def _offset(units: np.ndarray) -> np.ndarray:
        return (units >> np.uint32(10)) << ((units & np.uint32(0x200)) >> np.uint32(6))

    def replacement(self, value: int) -> np.ndarray:
        if value not in self.known:
            self.known[value] = np.frombuffer(self.texts[value : self.texts.index(b"\0", value)], np.uint8)
        return self.known[value]

    def longest(self, data: np.ndarray, at: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For places in ``data``: length and value of the longest rule that matches there and ends by ``stop`` (0: none)."""
        length, value = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        alive = np.arange(len(at))
        node = np.full(len(at), self._offset(self.units[:1])[0], np.uint32)
        depth = 0
        while len(alive):
            place = at[alive] + depth
            inside = place < stop[alive]
            alive, node, place = alive[inside], node[inside], place[inside]
            byte = data[place].astype(np.uint32)
            node = node ^ byte
            unit = self.units[np.minimum(node, len(self.units) - 1)]
            fits = (node < len(self.units)) & ((unit & np.uint32(0x800000FF)) == byte)
            alive, unit = alive[fits], unit[fits]
            node = node[fits] ^ self._offset(unit)
            depth += 1
            leaf = (unit & np.uint32(0x100)) != 0
            length[alive[leaf]] = depth
            value[alive[leaf]] = self.units[node[leaf]] & np.uint32(0x7FFFFFFF)
        return length, value


class Model:
    """A model file's pieces and rules, with what encoding and decoding need from them as arrays."""

    def __init__(self, definition: bytes) -> None:
        pieces, spec, trainer, other = [], {}, {}, {}
        for number, value in fields(definition):
            if number == 1:
                piece = dict(fields(value))
                pieces.append((piece[1].decode(), piece.get(3, _NORMAL)))
            elif number == 2:
                trainer |= dict(fields(value))
            elif number == 3:
                spec |= dict(fields(value))
            elif number == 5:
                other |= dict(fields(value))
        kinds = np.array([kind for _, kind in pieces])
        self.map = CharacterMap(spec[2]) if spec.get(2) else None
        self.prefix, self.squeeze = bool(spec.get(3, 1)), bool(spec.get(4, 1))
        if (kinds == _BYTE).sum() != 256:
            raise ValueError("the model has no byte fallback")
        if not spec.get(5, 1) or trainer.get(24) or other.get(2) or (self.map and b"  " in self.map.texts):
            raise ValueError("unescaped spaces, spaces as suffixes, double spaces in rules and denormalisers are not supported")
        if (self.map or self.squeeze) and (kinds == _USER).any():
            raise ValueError("user-defined pieces beside normalisation are not supported")
        self.control, self.byte = kinds == _CONTROL, kinds == _BYTE
        number = {piece: i for i, (piece, _) in enumerate(pieces)}
        self.bos = number.get(trainer.get(46, b"<s>").decode(), -1)
        self.eos = number.get(trainer.get(47, b"</s>").decode(), -1)
        self.names = [piece for piece, _ in pieces]
        unknown = trainer.get(44, " ⁇ ".encode())
        raw = [
            bytes([int(p[3:5], 16)]) if k == _BYTE else b"" if k == _CONTROL else unknown if k == _UNKNOWN else p.replace(SPACE, " ").encode()
            for p, k in pieces]
        # Surfaces of pieces, then those of pieces that open a text and lose a space there.
        opens = (self.prefix or self.squeeze) & np.array([p.startswith(SPACE) for p, _ in pieces])
        self.surfaces = pa.array(raw + [s[1:] if cut else s for s, cut in zip(raw, opens.tolist())], pa.large_binary())
        self.empty_first = np.array([cut and len(s) == 1 for s, cut in zip(raw, opens.tolist())])
        self.lengths = np.array([1 if k == _BYTE else 0 if k in (_CONTROL, _UNKNOWN) else len(p.encode()) for p, k in pieces], np.int64)
        # Characters that stand beside others in a piece; any other character is a stretch of its own.
        joined = [p for p, k in pieces if k not in (_BYTE, _CONTROL, _UNKNOWN) and len(p) > 1]
        letters = "".join(map(re.escape, sorted({c for p in joined for c in p} - {SPACE})))
        crossing = any(SPACE in p.lstrip(SPACE) for p in joined)
        self.stretch = re.compile(r"(?s).+" if crossing or not letters else f"(?s){SPACE}*[{letters}]+|{SPACE}+|.")
        # An empty map, no prefix, no squeezing: fields 2, 3 and 4 of the normaliser (field 3) as this library writes them.
        self.plain = definition + b"\x1a\x06\x12\x00\x18\x00\x20\x00"

    def normalise(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Normalised bytes of texts (as ``textmath.chunks`` gives them), where each byte's source begins, and the texts' borders.

        Each text is followed by one byte that belongs to no text; its source is the end of what was read of the text.
        """
        starts = np.flatnonzero((data & 0xC0) != 0x80)
        source = starts[np.cumsum((data & 0xC0) != 0x80) - 1].astype(np.int64) if len(data) else np.zeros(0, np.int64)
        ends, stream = offsets[1:] - 1, data
        if self.map:
            owner = np.searchsorted(offsets, starts, "right") - 1
            length, value = self.map.longest(data, starts, ends[owner])
            hit = np.flatnonzero(length)
            parts, places, last = [], [], 0
            for at, size, rule in zip(starts[hit].tolist(), length[hit].tolist(), value[hit].tolist()):
                if at >= last:
                    new = self.map.replacement(rule)
                    parts += [data[last:at], new]
                    places += [source[last:at], np.full(len(new), at, np.int64)]
                    last = at + size
            stream, source = np.concatenate([*parts, data[last:]]), np.concatenate([*places, source[last:]])
        close = np.searchsorted(source, ends)
        blank = stream == 0x20
        if self.squeeze:
            before = np.concatenate(([True], blank[:-1]))
            before[close[:-1] + 1] = True
            keep = ~(blank & before)
            stream, source, blank = stream[keep], source[keep], blank[keep]
            close = np.searchsorted(source, ends)
        size = np.where(blank, 3, 1)
        first = np.concatenate(([0], close[:-1] + 1)) if len(close) else close
        if self.prefix:
            first = first[np.diff(offsets) > 1]
            size[first] += 3
        place = np.cumsum(size) - size
        out = np.zeros(int(size.sum()), np.uint8)
        sign = np.frombuffer(SPACE.encode(), np.uint8)
        main = place.copy()
        if self.prefix:
            out[place[first][:, None] + np.arange(3)] = sign
            main[first] += 3
        out[main] = stream
        out[main[blank][:, None] + np.arange(3)] = sign
        source = np.repeat(source, size)
        borders = np.concatenate(([0], place[close] + size[close])) if len(close) else np.zeros(1, np.int64)
        return (out, source, borders) if not self.squeeze else self._trimmed(out, source, borders)

    @staticmethod
    def _trimmed(out: np.ndarray, source: np.ndarray, borders: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Without the space signs that end texts."""
        sign, cuts = SPACE.encode(), []
        drop = np.zeros(len(out), bool)
        source = source.copy()
        for lo, hi in zip(borders[:-1].tolist(), borders[1:].tolist()):
            end = hi - 1
            while end - 3 >= lo and out[end - 3 : end].tobytes() == sign:
                end -= 3
            if end < hi - 1:
                source[hi - 1] = source[end]
                drop[end : hi - 1] = True
            cuts.append(hi - 1 - end)
        return out[~drop], source[~drop], borders - np.concatenate(([0], np.cumsum(cuts)))

    def decode(self, ids: np.ndarray, first: np.ndarray) -> pa.Array:
        """Texts of id sequences that stand one after another; ``first`` has their borders."""
        ids = ids.astype(np.int64)
        owner, _ = ragged(np.diff(first))
        # Bytes on both sides of a control id are no character together.
        parted = self.control[ids].any() and bool((self.byte[ids[:-1]] & self.control[ids[1:]]).any())
        heard = np.flatnonzero(~self.control[ids])
        opens = np.flatnonzero(np.diff(owner[heard], prepend=-1))
        while len(opens):
            empty = self.empty_first[ids[heard[opens]]]
            ids[heard[opens]] += len(self.names)
            # Where leading spaces go, a piece that is nothing else leaves the next one to open the text.
            opens = opens[empty] + 1 if self.squeeze else opens[:0]
            opens = opens[opens < len(heard)]
            opens = opens[owner[heard[opens]] == owner[heard[opens - 1]]]
        shown = self.surfaces.take(pa.array(ids))
        joined = pc.binary_join(pa.LargeListArray.from_arrays(pa.array(first), shown), pa.scalar(b"", pa.large_binary()))
        try:
            if not parted:
                return joined.cast(pa.string())
        except pa.ArrowInvalid:
            pass
        names = len(self.names)
        out = []
        for lo, hi in zip(first[:-1].tolist(), first[1:].tolist()):
            cuts = [lo, *(lo + np.flatnonzero(self.control[ids[lo:hi] % names])).tolist(), hi]
            out.append("".join([b"".join(shown[a:b].to_pylist()).decode("utf-8", "subwords_each") for a, b in zip(cuts, cuts[1:])]))
        return pa.array(out, pa.string())


def _each(error: UnicodeError) -> tuple[str, int]:
    """Every byte that is part of no character becomes a replacement sign of its own."""
    return "�", error.start + 1


class Encoder:
    def __init__(self, definition: bytes) -> None:
        from sentencepiece import SentencePieceProcessor

        codecs.register_error("subwords_each", _each)
        self.model = Model(definition)
        self.library = SentencePieceProcessor(model_proto=self.model.plain)
        self.known: dict[str, bytes] = {}
        self.size = 0

    def _ids(self, texts: list[str]) -> list[bytes]:
        """Ids of normalised texts; stretches that are not remembered go to the library together."""
        cut = [self.model.stretch.findall(t) for t in texts]
        needed = set().union(*cut)
        new = [s for s in needed if s not in self.known]
        if self.size > KNOWN:
            self.known = {s: self.known[s] for s in needed if s in self.known}
            self.size = sum(map(len, self.known))
        for stretch, ids in zip(new, self.library.encode(new, add_bos=False, add_eos=False, num_threads=1)):
            self.known[stretch] = np.asarray(ids, "<u4").tobytes()
            self.size += len(stretch)
        return [b"".join(map(self.known.__getitem__, c)) for c in cut]

    def encode(self, data: np.ndarray, offsets: np.ndarray, bos: bool = True, eos: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all texts, the borders of the texts among them, and begin and end of every piece in its text's bytes."""
        model = self.model
        out, source, borders = model.normalise(data, offsets)
        held = out.tobytes()
        opening = np.asarray([model.bos] if bos else [], "<u4").tobytes()
        closing = np.asarray([model.eos] if eos else [], "<u4").tobytes()
        parts = [opening + p + closing for p in self._ids([held[lo : hi - 1].decode() for lo, hi in zip(borders[:-1].tolist(), borders[1:].tolist())])]
        counts = np.array([len(p) // 4 for p in parts], np.int64)
        ids = np.frombuffer(b"".join(parts), "<u4")
        first = np.concatenate(([0], np.cumsum(counts)))
        owner, _ = ragged(counts)
        size = model.lengths[ids]
        begin = np.cumsum(size) - size + owner
        if not np.array_equal(np.bincount(owner, size, len(counts)).astype(np.int64), np.diff(borders) - 1):
            raise ValueError("the pieces of a text do not add up to it")
        base = offsets[:-1][owner]
        start, stop = source[begin] - base, source[begin + size] - base
        if bos and len(counts):
            start[first[:-1]] = stop[first[:-1]] = 0
        if eos and len(counts):
            start[first[1:] - 1] = stop[first[1:] - 1] = np.diff(offsets) - 1
        return ids, first, start, stop


def _binary(values: np.ndarray, borders: np.ndarray) -> pa.Array:
    """Slices of little-endian unsigned 32-bit numbers as binary values."""
    data = np.ascontiguousarray(values, "<u4")
    return pa.Array.from_buffers(pa.large_binary(), len(borders) - 1, [None, pa.py_buffer((borders * 4).astype(np.int64)), pa.py_buffer(data)]).cast(pa.binary())


def encode(docs: DataFrame, model_path: str, text: str = "text", carry: list[str] = ["doc_id"], bos: bool = True, eos: bool = True) -> DataFrame:
    """``carry`` columns with n_tokens, ids, spans and decoded for every row.

    ``ids`` and ``spans`` hold little-endian unsigned 32-bit numbers: the ids, and begin and end of every piece in the bytes
    of the original text. ``decoded`` is the text of the ids. ``pieces`` unfolds them.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(Path(model_path).read_bytes())

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shipped.value)
        for batch in batches:
            for lo, hi, data, offsets in chunks(batch["_text"]):
                ids, first, start, stop = encoder.encode(data, offsets, bos, eos)
                kept = [batch[c].slice(lo, hi - lo) for c in carry]
                spans = _binary(np.stack([start, stop], 1).ravel(), first * 2)
                yield pa.RecordBatch.from_arrays([*kept, pa.array(np.diff(first)), _binary(ids, first), spans, encoder.model.decode(ids, first)], names)

    names = [*carry, "n_tokens", "ids", "spans", "decoded"]
    source = docs.select(*carry, F.col(text).alias("_text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1])
    return source.mapInArrow(work, f"{kinds + ', ' if kinds else ''}n_tokens bigint, ids binary, spans binary, decoded string")


def pieces(encoded: DataFrame, model_path: str, carry: list[str] = ["doc_id"]) -> DataFrame:
    """One row per piece of what ``encode`` gave: ``carry`` columns, position (from 0), id, piece, start and stop."""
    shipped = encoded.sparkSession.sparkContext.broadcast(Path(model_path).read_bytes())

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = pa.array(Model(shipped.value).names, pa.string())
        for batch in batches:
            for row in range(batch.num_rows):
                ids = np.frombuffer(batch["ids"][row].as_buffer(), "<u4").astype(np.int64)
                spans = np.frombuffer(batch["spans"][row].as_buffer(), "<u4").astype(np.int64).reshape(-1, 2)
                kept = [pa.array([batch[c][row].as_py()] * len(ids), batch[c].type) for c in carry]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(np.arange(len(ids))), pa.array(ids), names.take(pa.array(ids)), pa.array(spans[:, 0]), pa.array(spans[:, 1])], out)

    out = [*carry, "position", "id", "piece", "start", "stop"]
    source = encoded.select(*carry, "ids", "spans")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-2])
    return source.mapInArrow(work, f"{kinds + ', ' if kinds else ''}position bigint, id bigint, piece string, start bigint, stop bigint")


def encode_corpus(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and spans_sha256 of every whole text, with begin and end ids."""
    found = encode(docs.select("doc_id", "text"), model_path)
    return found.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"), F.sha2("spans", 256).alias("spans_sha256"))
