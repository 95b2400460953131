"""SentencePiece encoding and decoding with a model of merges (BPE), by a prefix table.

Merging, best piece first and leftmost of equals, gives every prefix of a text one
last piece, and a row of pieces is what merging gives exactly if each pair of
neighbours is what merging gives of the two ("compatible"). So an automaton over all
pieces runs along the text once; of the pieces that end at a place, the one whose
predecessor, the last piece of the prefix before it, is compatible with it is
noted; from the end of the text the notes are followed backwards.

Two pieces are tested by undoing their merges, the later one first, and looking
whether the letters at the seam would have been merged across it in between. Pieces of
blanks alone share one score, so pairs of them are merged in full instead.

A text is cut where no piece crosses: before a blank that follows a letter, if no piece
has a blank inside, and around letters that stand in no piece of two letters or more.
What is between cuts is encoded once and remembered, up to ``KEPT`` parts.

Everything happens within a row: no exchange.

Defined cases: a null or empty text is the begin and end ids alone and decodes to the
empty text; letters without a piece are the ids of their bytes; repeated rows are
encoded each; rows without id keep the null; no rows give none; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import codecs
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tabularium.llm.common import spread

MODEL = "piece_bpe_32k.model"
BLANK = "▁"
KEPT, SHORT = 400_000, 64
_NORMAL, _UNKNOWN, _CONTROL, _BYTE = 1, 2, 3, 6


def _one_by_one(e: UnicodeDecodeError) -> tuple[str, int]:
    return "�", e.start + 1


codecs.register_error("tabularium-bytes", _one_by_one)


class _Parts(dict):
    """Packed ids of the parts of texts, made when first asked for. What was not asked for since half of ``KEPT`` others came goes."""

    def __init__(self, make):
        super().__init__()
        self.make, self.before = make, {}

    def __missing__(self, part: str) -> bytes:
        out = self.before.get(part)
        if out is None:
            out = self.make(part)
        if len(part) <= SHORT:
            self[part] = out
        return out

    def turn(self) -> None:
        if len(self) > KEPT // 2:
            self.before = dict(self)
            self.clear()


class Pieces:
    """Encoder and decoder of one model file."""

    def __init__(self, file: str):
        import ahocorasick
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(file, "rb") as f:
            model.ParseFromString(f.read())
        told = model.normalizer_spec
        if model.trainer_spec.model_type != 2 or told.precompiled_charsmap or told.remove_extra_whitespaces or not told.escape_whitespaces or model.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("only models of merges are known that leave letters and blanks as they are")
        if any(p.type not in (_NORMAL, _UNKNOWN, _CONTROL, _BYTE) for p in model.pieces):
            raise ValueError("pieces that a user has defined, and unused ones, are not known")
        self.dummy = told.add_dummy_prefix
        self.begin, self.end, self.unknown = (np.array([k], "<u4").tobytes() for k in (model.trainer_spec.bos_id, model.trainer_spec.eos_id, model.trainer_spec.unk_id))
        self.byte_ids = {int(p.piece[1:-1], 16): k for k, p in enumerate(model.pieces) if p.type == _BYTE}
        self.id = {p.piece: k for k, p in enumerate(model.pieces) if p.type == _NORMAL}
        self.packed = {p: k.to_bytes(4, "little") for p, k in self.id.items()}
        self.cost = {p.piece: -p.score for p in model.pieces if p.type == _NORMAL}
        #: The two parts that a piece of several letters was last merged from. A piece that merging never makes has none and does not occur.
        self.made: dict[str, tuple[str, str]] = {}
        self.steady = True  # whether every piece is merged later than its parts, pieces of blanks aside
        for p in self.id:
            if len(p) > 1:
                got = self.merged(p)
                if len(got[0]) == 1:
                    self.made[p] = got[1]
        for p, parts in self.made.items():
            if p.strip(BLANK) and any(len(x) > 1 and self.cost[x] >= self.cost[p] for x in parts):
                self.steady = False
        self.automaton = ahocorasick.Automaton()
        letters = {c for p in self.id for c in p}
        for p in (*self.made, *letters):
            self.automaton.add_word(p, p)
        self.automaton.make_automaton()
        self.fits: dict[tuple[str, str], bool] = {}
        inner = sorted({c for p in self.made for c in p} - {BLANK})
        known = "".join(map(re.escape, inner))
        crossed = any(a != BLANK and b == BLANK for p in self.made for a, b in zip(p, p[1:]))
        self.cut = re.compile(f"[{BLANK}{known}]+|[^{BLANK}{known}]+" if crossed else f"{BLANK}+[{known}]*|[{known}]+|[^{BLANK}{known}]+").findall
        self.parts = _Parts(self.encode_part)
        self.bytes_of = [b""] * len(model.pieces)
        self.kind = np.array([p.type for p in model.pieces], np.uint8)
        for k, p in enumerate(model.pieces):
            self.bytes_of[k] = {_NORMAL: lambda x: x.replace(BLANK, " ").encode(), _UNKNOWN: lambda x: (model.trainer_spec.unk_surface or " ⁇ ").encode(), _BYTE: lambda x: bytes([int(x[1:-1], 16)]), _CONTROL: lambda x: b""}[p.type](p.piece)

    def merged(self, part: str) -> tuple[list[str], tuple[str, str] | None]:
        """What merging in full makes of a short text, and the last two parts merged."""
        row, last = list(part), None
        while True:
            near = [(self.cost[a + b], i) for i, (a, b) in enumerate(zip(row, row[1:])) if a + b in self.cost]
            if not near:
                return row, last
            i = min(near)[1]
            last = row[i], row[i + 1]
            row[i : i + 2] = [row[i] + row[i + 1]]

    def compatible(self, a: str, b: str) -> bool:
        """Whether merging leaves the seam between two pieces."""
        key = a, b
        known = self.fits.get(key)
        if known is None:
            if len(self.fits) > 4 * KEPT:
                self.fits.clear()
            known = self.fits[key] = self._undone(a, b) if self.steady and (a.strip(BLANK) or b.strip(BLANK)) else self.merged(a + b)[0] == [a, b]
        return known

    def _undone(self, a: str, b: str) -> bool:
        cost, made, never = self.cost, self.made, float("inf")
        until_a = until_b = never
        while True:
            across = cost.get(a + b, never)
            # Of equal merges the left one is first: the one inside the left piece goes before the seam, the seam before the right piece.
            if across < until_a and across <= until_b and across < never:
                return False
            in_a, in_b = a in made, b in made
            if not in_a and not in_b:
                return True
            if in_a and (not in_b or cost[a] > cost[b]):
                until_a, a = cost[a], made[a][1]
            else:
                until_b, b = cost[b], made[b][0]

    def prefix_table(self, part: str) -> list[str | None]:
        """The last piece of every prefix; a letter of no piece stands for itself."""
        last: list[str | None] = [None] * (len(part) + 1)
        done = 0
        for at, piece in self.automaton.iter(part):
            at += 1
            while done < at - 1:  # letters of no piece, before this place
                done += 1
                last[done] = last[done] or part[done - 1]
            if last[at] is None:
                start = at - len(piece)
                if not start or self.compatible(last[start], piece):
                    last[at], done = piece, at
        for k in range(done + 1, len(part) + 1):
            last[k] = part[k - 1]
        return last

    def pieces(self, part: str) -> list[str]:
        # As in prefix_table, where all letters are of pieces.
        last, fits = [None] * (len(part) + 1), self.fits
        for at, piece in self.automaton.iter(part):
            at += 1
            if last[at] is None:
                start = at - len(piece)
                if not start:
                    last[at] = piece
                else:
                    before = last[start]
                    if before is None:
                        break  # beside a letter of no piece
                    known = fits.get((before, piece))
                    if known or known is None and self.compatible(before, piece):
                        last[at] = piece
        if None in last[1:]:
            last = self.prefix_table(part)
        at, out = len(part), []
        while at:
            out.append(last[at])
            at -= len(last[at])
        return out[::-1]

    def encode_part(self, part: str) -> bytes:
        return b"".join(map(self._ids, self.pieces(part)))

    def _ids(self, piece: str) -> bytes:
        known = self.packed.get(piece)
        if known is not None:
            return known
        own = [self.byte_ids.get(x) for x in piece.encode()]
        return self.unknown if None in own else np.array(own, "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        """Packed little-endian ids of a text, with those of begin and end."""
        if not text:
            return self.begin + self.end
        self.parts.turn()
        whole = (BLANK if self.dummy else "") + text.replace(" ", BLANK)
        return self.begin + b"".join(map(self.parts.__getitem__, self.cut(whole))) + self.end

    def decode(self, ids: np.ndarray) -> bytes:
        """UTF-8 of the text that ids stand for."""
        marks = np.flatnonzero(self.kind[ids] == _CONTROL)
        rows = [r[self.kind[r] != _CONTROL] for r in np.split(ids, marks)]  # bytes on both sides of a mark are no letter
        rows = [r for r in rows if len(r)]
        out = [self._spelled(b"".join(map(self.bytes_of.__getitem__, r.tolist()))) for r in rows]
        if self.dummy and rows and self.kind[rows[0][0]] == _NORMAL and out[0][:1] == b" ":
            out[0] = out[0][1:]
        return b"".join(out)

    @staticmethod
    def _spelled(raw: bytes) -> bytes:
        """Bytes that are no UTF-8 become U+FFFD, each."""
        try:
            raw.decode()
        except UnicodeDecodeError:
            return raw.decode(errors="tabularium-bytes").encode()
        return raw


_loaded: dict[str, Pieces] = {}


def loaded(file: str | None = None) -> Pieces:
    """The model of a file, read once a process."""
    key = file or ""
    if key not in _loaded:
        if file is None:
            import public_tokenizers

            file = str(public_tokenizers.path(MODEL))
        _loaded[key] = Pieces(file)
    return _loaded[key]


def encode_documents(docs: DataFrame, model_file: str | None = None) -> DataFrame:
    """``doc_id, ids`` (packed little-endian unsigned 32-bit) of every text, with begin and end ids."""

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = loaded(model_file)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([known.encode(t or "") for t in b.column(1).to_pylist()], pa.binary())], names=["doc_id", "ids"])

    return spread(docs.select("doc_id", "text")).mapInArrow(encoded, "doc_id bigint, ids binary")


def decode_documents(coded: DataFrame, model_file: str | None = None) -> DataFrame:
    """``doc_id, text`` of packed ids."""

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = loaded(model_file)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([known.decode(np.frombuffer(x or b"", "<u4")).decode() for x in b.column(1).to_pylist()], pa.string())], names=["doc_id", "text"])

    return coded.select("doc_id", "ids").mapInArrow(decoded, "doc_id bigint, text string")


def round_trip(docs: DataFrame, model_file: str | None = None) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of every text, encoded and decoded in one pass."""

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = loaded(model_file)
        sha = lambda x: hashlib.sha256(x).hexdigest()
        for b in batches:
            n, coded, plain = [], [], []
            for t in b.column(1).to_pylist():
                ids = known.encode(t or "")
                n.append(len(ids) // 4)
                coded.append(sha(ids))
                plain.append(sha(known.decode(np.frombuffer(ids, "<u4"))))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(coded, pa.string()), pa.array(plain, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return spread(docs.select("doc_id", "text")).mapInArrow(digests, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
