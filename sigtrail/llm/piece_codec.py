"""SentencePiece encoding and decoding, exact for models of merge type, by backtracking.

A text becomes its escaped form (a dummy prefix, spaces as the meta symbol) and is cut before each run of meta symbols: the
vocabulary has no piece with a meta symbol after another character, so no merge crosses such a cut (checked on loading).
Each unit is encoded left to right: the longest piece that starts here (from one Aho-Corasick pass) is taken if it may stand
after the last one, else the next shorter; if none fits, the last piece is taken back and its end is marked in a bitfield of
failed positions. Two pieces may be neighbours if merging their joint text by the model's rule gives just them again.

Pieces of meta symbols only share one score, so that ties rule their merges and the argument for backtracking doesn't hold:
units that start with two or more meta symbols are merged by the rule itself.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sigtrail.llm.common import small_batches, table, text_of

META = "▁"
#: Longest unit, units and pairs of pieces that a worker keeps.
MEMO_CHARS, MEMO_UNITS, MEMO_PAIRS = 40, 250_000, 500_000


class PieceCodec:
    """Vocabulary, merge rule, encoder and decoder of one model."""

    def __init__(self, path: str) -> None:
        import ahocorasick
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        special = {i for i in range(len(self.pieces)) if model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)}
        self.rank = {p: model.get_score(i) for i, p in enumerate(self.pieces) if i not in special}
        self.id = {p: i for i, p in enumerate(self.pieces) if i not in special}
        self.byte_id = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if model.is_byte(i)}
        self.id_byte = {i: b for b, i in self.byte_id.items()}
        self.control = {i for i in special if model.is_control(i)}
        self.unknown, self.end = model.unk_id(), model.eos_id()
        if any(META in p.lstrip(META) for p in self.rank):
            raise ValueError("a piece has a meta symbol inside: texts can't be cut there")
        #: A piece that its own text doesn't merge to never occurs.
        own = {p: i for p, i in self.id.items() if len(p) == 1 or self.merged(p) == [p]}
        self.automaton = ahocorasick.Automaton()
        for p, i in own.items():
            self.automaton.add_word(p, (len(p), i))
        self.automaton.make_automaton()
        self.decimal = [str(i) for i in range(len(self.pieces))]
        self.length = [len(p) for p in self.pieces]
        #: For each piece the longest shorter one that it begins with, or -1.
        self.shorter = [next((own[p[:k]] for k in range(len(p) - 1, 0, -1) if p[:k] in own), -1) for p in self.pieces]
        self.known = frozenset(p for p in self.rank if len(p) == 1)
        self.lowest = 1 + max(special, default=-1)
        self.unit = re.compile(f"{META}+[^{META}]*|[^{META}]+")
        self._pairs: dict[int, bool] = {}
        self._units: dict[str, tuple[str, str]] = {}
        self._older: dict[str, tuple[str, str]] = {}

    def merged(self, text: str) -> list[str]:
        """The model's rule: again and again merge the neighbours whose joint piece has the best score, leftmost first."""
        parts: list[str] = list(text)
        after, before = [*range(1, len(parts)), -1], list(range(-1, len(parts) - 1))
        heap: list[tuple[float, int, str, int]] = []

        def offer(left: int, right: int) -> None:
            if left >= 0 and right >= 0 and (score := self.rank.get(joint := parts[left] + parts[right])) is not None:
                heapq.heappush(heap, (-score, left, joint, right))

        for k in range(len(parts) - 1):
            offer(k, k + 1)
        while heap:
            _, left, joint, right = heapq.heappop(heap)
            if not parts[left] or not parts[right] or after[left] != right or parts[left] + parts[right] != joint:
                continue
            parts[left], parts[right] = joint, ""
            after[left] = after[right]
            if after[right] >= 0:
                before[after[right]] = left
            offer(before[left], left)
            offer(left, after[left])
        return [p for p in parts if p]

    def fits(self, left: int, right: int) -> bool:
        """Whether the two pieces stay as they are side by side."""
        known = self._pairs.get(left << 32 | right)
        if known is None:
            if len(self._pairs) >= MEMO_PAIRS:
                self._pairs.clear()
            a, b = self.pieces[left], self.pieces[right]
            known = self._pairs[left << 32 | right] = self.merged(a + b) == [a, b]
        return known

    def _backtrack(self, text: str) -> list[int]:
        """Encode a stretch of known characters."""
        n = len(text)
        longest = [-1] * n
        for last, (size, piece) in self.automaton.iter(text):
            longest[last - size + 1] = piece  # the longer the later
        failed = bytearray(n // 8 + 1)
        taken: list[int] = []
        length, shorter, known, fits = self.length, self.shorter, self._pairs.get, self.fits
        pos, piece, before = 0, longest[0], -1
        while True:
            while piece >= 0:
                end = pos + length[piece]
                if not failed[end >> 3] >> (end & 7) & 1:
                    if before < 0:
                        break
                    fit = known(before << 32 | piece)
                    if fit or fit is None and fits(before, piece):
                        break
                piece = shorter[piece]
            if piece >= 0:
                taken.append(piece)
                if end == n:
                    return taken
                pos, before, piece = end, piece, longest[end]
            elif taken:
                failed[pos >> 3] |= 1 << (pos & 7)
                last = taken.pop()
                pos -= length[last]
                before, piece = taken[-1] if taken else -1, shorter[last]
            else:
                return [self.id[p] for p in self.merged(text)]  # no sequence fits pair by pair: the model's rule itself

    def _stretch(self, text: str) -> list[int]:
        return [self.id[p] for p in self.merged(text)] if text.startswith(META * 2) else self._backtrack(text)

    def encode_unit(self, unit: str) -> list[int]:
        """Ids of one unit. Characters that no piece has are bytes, and nothing merges across them."""
        if self.known.issuperset(unit):
            return self._stretch(unit)
        ids: list[int] = []
        begin = 0
        for k in range(len(unit) + 1):
            if k < len(unit) and unit[k] in self.known:
                continue
            if begin < k:
                ids += self._stretch(unit[begin:k])
            if k < len(unit):
                ids += [self.byte_id.get(b, self.unknown) for b in unit[k].encode()]
            begin = k + 1
        return ids

    def decode(self, ids: list[int]) -> str:
        """The text of ids: bytes joined to characters, meta symbols to spaces, without the dummy prefix and control ids."""
        return self._joined(ids).removeprefix(" ")

    def _joined(self, ids: list[int]) -> str:
        if ids and min(ids) >= self.lowest:
            return "".join([self.pieces[i] for i in ids]).replace(META, " ")
        out, run = [], bytearray()
        for i in [*ids, -1]:
            if i in self.id_byte:
                run.append(self.id_byte[i])
                continue
            if run:
                out.append(run.decode("utf-8", "replace"))
                run = bytearray()
            if i >= 0 and i not in self.control:
                out.append(self.pieces[i].replace(META, " "))
        return "".join(out)

    def _known(self, unit: str) -> tuple[str, str]:
        """Ids and text of a unit; units of two generations are kept, and what is used again stays."""
        found = self._older.get(unit)
        if found is None:
            ids = self.encode_unit(unit)
            found = (" ".join([self.decimal[i] for i in ids]), self._joined(ids))
        if len(unit) <= MEMO_CHARS:
            if len(self._units) >= MEMO_UNITS:
                self._older, self._units = self._units, {}
            self._units[unit] = found
        return found

    def encode(self, text: str) -> tuple[str, str]:
        """Decimal ids joined by one space, with the end id, and the decoded text."""
        if not text:
            return str(self.end), ""
        memo, known = self._units.get, self._known
        found = [memo(u) or known(u) for u in self.unit.findall(META + text.replace(" ", META))]
        return " ".join([ids for ids, _ in found]) + f" {self.end}", "".join([t for _, t in found]).removeprefix(" ")


@lru_cache(maxsize=2)
def codec(path: str) -> PieceCodec:
    return PieceCodec(path)


def _run(path: str, schema: pa.Schema, texts_too: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            n, ids_sha, text_sha, ids_out, texts_out = [], [], [], [], []
            for value in batch.column("text"):
                ids, text = own.encode(value.as_py())
                n.append(ids.count(" ") + 1)
                ids_sha.append(hashlib.sha256(ids.encode()).hexdigest())
                text_sha.append(hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest())
                if texts_too:
                    ids_out.append([int(i) for i in ids.split(" ")])
                    texts_out.append(text)
            more = [pa.array(ids_out, schema.field("ids").type), pa.array(texts_out, pa.string())] if texts_too else []
            yield pa.record_batch([batch.column("doc_id").cast(schema.field("doc_id").type), pa.array(n, pa.int64()), pa.array(ids_sha), pa.array(text_sha), *more], schema=schema)

    return run


def encode_pieces(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", texts_too: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 (and, with texts_too, ids and decoded): one row for each row of docs.

    Encoded with an end id, without sampling; null counts as empty: the end id only. Rows that repeat, and null ids, get a row
    each. Other columns are not read. An empty table gives no rows. No shuffle: each task encodes the rows that it reads.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    small_batches(docs.sparkSession)
    base = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    fields = [base.schema["doc_id"], T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    if texts_too:
        fields += [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())]
    schema = T.StructType(fields)
    return base.mapInArrow(_run(model_path, to_arrow_schema(schema), texts_too), schema)


def op5_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


QUERIES = {"op5_piece_codec": op5_piece_codec}
ORACLE_SQL: dict[str, str] = {}
