"""Vocabularies of tokenizer files, as a PySpark Python data source: a row for each token id.

Columns: ``token_id``; ``token_str``, the text that the id alone stands for; ``piece``, the token as the file writes it;
``special``, whether it is one of the file's added or control tokens. Files: ``.json`` of the tokenizers library,
``.tiktoken`` ranks, ``.model`` of sentencepiece, told apart by their endings. Bytes that are no text by themselves show
as replacement characters, as they do where a tokenizer decodes such an id.

A partition is a range of ids. Comparisons of ``token_id`` choose the ranges before any is read, and texts are only made
where ``token_str`` is among the columns that the schema asks for.
"""

from __future__ import annotations

import base64
import json
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from strataspan.sources.manifested import filesystem, holds

RANGE_IDS = 16_384
COLUMNS = T.StructType([T.StructField("token_id", T.LongType()), T.StructField("token_str", T.StringType()), T.StructField("piece", T.StringType()), T.StructField("special", T.BooleanType())])


def byte_marks() -> dict[str, int]:
    """The characters that byte-level vocabularies write bytes as: printable ones as they are, the others, in order, from
    code point 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


class JsonVocabulary:
    def __init__(self, data: bytes):
        spec = json.loads(data)
        self.added = {x["id"]: x for x in spec.get("added_tokens", [])}
        self.pieces = {i: p for p, i in spec["model"]["vocab"].items()} | {i: x["content"] for i, x in self.added.items()}
        decoder = spec.get("decoder") or {}
        kinds = {decoder.get("type"), *(d.get("type") for d in decoder.get("decoders", []))}
        self.marks = byte_marks() if "ByteLevel" in kinds else None
        self.suffix = spec["model"].get("end_of_word_suffix") or ""

    def special(self, i: int) -> bool:
        return bool(i in self.added and self.added[i].get("special"))

    def text(self, i: int) -> str:
        piece = self.pieces[i]
        if i in self.added:
            return piece
        if self.marks and all(c in self.marks for c in piece):
            return bytes(self.marks[c] for c in piece).decode("utf-8", "replace")
        return piece.removesuffix(self.suffix) if self.suffix else piece


class RankVocabulary:
    def __init__(self, data: bytes):
        self.bytes = {int(rank): base64.b64decode(word) for word, rank in (line.split() for line in data.splitlines() if line.strip())}
        self.pieces = {i: b.decode("utf-8", "backslashreplace") for i, b in self.bytes.items()}

    def special(self, i: int) -> bool:
        return False

    def text(self, i: int) -> str:
        return self.bytes[i].decode("utf-8", "replace")


class PieceVocabulary:
    def __init__(self, data: bytes):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_proto=data)
        self.pieces = {i: self.model.id_to_piece(i) for i in range(self.model.get_piece_size())}

    def special(self, i: int) -> bool:
        return self.model.is_control(i) or self.model.is_unknown(i)

    def text(self, i: int) -> str:
        if self.model.is_byte(i):
            return bytes([int(self.pieces[i][3:-1], 16)]).decode("utf-8", "replace")
        return self.pieces[i].replace("▁", " ")


KINDS = {"json": JsonVocabulary, "tiktoken": RankVocabulary, "model": PieceVocabulary}


def load_vocabulary(uri: str):
    kind = KINDS.get(uri.rpartition(".")[2])
    if kind is None:
        raise ValueError(f"{uri} is none of {sorted(KINDS)}")
    fs, path = filesystem(uri)
    with fs.open_input_stream(path) as f:
        return kind(f.read())


@dataclass
class Ids(ds.InputPartition):
    lo: int
    hi: int

    def __post_init__(self):
        super().__init__((self.lo, self.hi))


class VocabularyReader(ds.DataSourceReader):
    def __init__(self, schema: T.StructType, options: dict):
        self.schema, self.uri = to_arrow_schema(schema), options["path"]
        unknown = set(schema.fieldNames()) - set(COLUMNS.fieldNames())
        if unknown:
            raise ValueError(f"a vocabulary has no columns {sorted(unknown)}")
        self.step = int(options.get("rangeids", RANGE_IDS))
        self.filters: list[ds.Filter] = []

    def pushFilters(self, filters):
        for f in filters:
            if getattr(f, "attribute", ()) == ("token_id",) and holds(f):
                self.filters.append(f)
            else:
                yield f

    def wanted(self, ids: list[int]) -> list[int]:
        tests = [holds(f) for f in self.filters]
        return [i for i in ids if all(t({"token_id": i}) for t in tests)]

    def partitions(self):
        ids = self.wanted(sorted(load_vocabulary(self.uri).pieces))
        return [Ids(part[0], part[-1] + 1) for part in (ids[k : k + self.step] for k in range(0, len(ids), self.step))] or [Ids(0, 0)]

    def read(self, part: Ids) -> Iterator[pa.RecordBatch]:
        if part.lo >= part.hi:
            return
        vocabulary = load_vocabulary(self.uri)
        ids = self.wanted([i for i in range(part.lo, part.hi) if i in vocabulary.pieces])
        values = {"token_id": lambda i: i, "token_str": vocabulary.text, "piece": vocabulary.pieces.get, "special": vocabulary.special}
        for k in range(0, len(ids), 4096):
            yield pa.RecordBatch.from_arrays([pa.array(map(values[f.name], ids[k : k + 4096]), f.type) for f in self.schema], schema=self.schema)


class VocabularySource(ds.DataSource):
    @classmethod
    def name(cls):
        return "vocabulary"

    def schema(self):
        return COLUMNS

    def reader(self, schema):
        return VocabularyReader(schema, self.options)


def read_vocabulary(spark: SparkSession, path: str, columns: str | T.StructType = COLUMNS, **options: str) -> DataFrame:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(VocabularySource)
    return spark.read.format("vocabulary").schema(columns).options(**options).load(path)


def with_texts(rows: DataFrame, vocabulary: DataFrame, missing: str | None = None) -> DataFrame:
    """Rows with the text of their ``token_id``; an id that the vocabulary lacks has the text ``missing``, or is an error
    where none is given. A row without an id is always an error."""
    texts = vocabulary.select(F.col("token_id").alias("__id"), F.struct("token_str").alias("__text"))
    lost = F.raise_error(F.concat(F.lit("no text for token "), F.coalesce(F.col("token_id").cast("string"), F.lit("null")))).cast("string")
    if missing is not None:
        lost = F.when(F.col("token_id").isNotNull(), F.lit(missing)).otherwise(lost)
    found = rows.join(texts, F.col("token_id") == F.col("__id"), "left")
    return found.select(*rows.columns, F.when(F.col("__text").isNull(), lost).otherwise(F.col("__text.token_str")).alias("token_str"))
