"""Token-ID output: flat unsigned integer files with 64-bit document offsets, read by memory map.

Layout of a dataset, one set of files for each partition p (rows in ascending document id):
  part-p.bin   token ids, little-endian, 16 bits where the vocabulary allows, else 32
  part-p.off   64-bit offsets into part-p.bin, in tokens, one more than documents
  part-p.doc   64-bit document ids (with a leading flag byte each in part-p.nul where ids are null)
The place of a partition's first token in the whole dataset (its base) is a prefix sum of the
partitions' token counts; only those counts, one row for each partition, reach the driver.

A task writes to a name of its own and renames it when complete, so a lost or repeated task leaves
either nothing or the same bytes. Files lie in the shared folder (spark.checkpoint.dir).

Defined results: null text counts as empty and gives the end id alone; null ids come first; rows with
equal ids are ordered by their text; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import os
import re
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.llm.bpe import WHITE, Memo
from quillmill.llm.common import load, shared_folder

_WORDS = re.compile(f"[^{WHITE}]+")


class WordEncoder:
    """Encodes text with the public library, word by word: its normaliser and splitter never cross white space."""

    def __init__(self, path: str, dtype: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.code = Tokenizer.from_file(path), "H" if dtype == "<u2" else "I"
        self.memo = Memo(self._encode)

    def _encode(self, word: str) -> bytes:
        return array(self.code, self.tokenizer.encode_batch_fast([word], add_special_tokens=False)[0].ids).tobytes()

    def batch(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as bytes; the words that are new in these texts are encoded in one call."""
        memo = self.memo
        # A-Z go first: the normaliser lower-cases them anyway, but special strings are matched as they stand.
        words = [_WORDS.findall(t if "<|" in t else t.encode().lower().decode()) for t in texts]
        new = [w for w in set().union(*words) if w not in memo and w not in memo.old]
        for w, e in zip(new, self.tokenizer.encode_batch_fast(new, add_special_tokens=False), strict=True):
            memo[w] = array(self.code, e.ids).tobytes()
        return [b"".join(map(memo.__getitem__, own)) for own in words]


_encoders: dict[tuple[str, str], WordEncoder] = {}


def _encoder(path: str, dtype: str) -> WordEncoder:
    if (path, dtype) not in _encoders:
        _encoders[path, dtype] = WordEncoder(path, dtype)
    return _encoders[path, dtype]


def id_width(path: str, end_id: int) -> str:
    """The smallest of uint16 and uint32 that holds every id."""
    from tokenizers import Tokenizer

    most = max(max(Tokenizer.from_file(path).get_vocab(with_added_tokens=True).values()), end_id)
    return "<u2" if most < 1 << 16 else "<u4"


def write_tokens(docs: DataFrame, folder: str, path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> tuple[list[tuple[int, int, int, int]], str]:
    """Writes the files; returns [(partition, base in tokens, documents, tokens)] and the ids' dtype.

    Range partitioning by id makes the order global; each task sorts its own range only.
    """
    dtype = id_width(path, end_id)
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_col).cast("long").alias("d"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    ordered = rows.repartitionByRange(n, "d").sortWithinPartitions("d", "t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, encode, end = TaskContext.get().partitionId(), _encoder(path, dtype), np.array([end_id], dtype).tobytes()
        store, root = pafs.FileSystem.from_uri(folder)
        names = {k: f"{root}/.{uuid.uuid4().hex}.{k}" for k in ("bin", "off", "doc", "nul")}
        out = {k: store.open_output_stream(v) for k, v in names.items()}
        out["off"].write(np.zeros(1, "<u8").tobytes())
        docs_n = tokens = 0
        for batch in batches:
            sizes, ids = [], batch.column(0)
            for i in range(0, len(batch), 200):
                for data in encode.batch(batch.column(1).slice(i, 200).to_pylist()):
                    out["bin"].write(data + end)
                    sizes.append(len(data) // int(dtype[-1]) + 1)
            ends = tokens + np.cumsum(np.array(sizes, "<u8"), dtype="<u8")
            out["off"].write(ends.tobytes())
            out["doc"].write(ids.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8").tobytes())
            out["nul"].write(ids.is_null().to_numpy(zero_copy_only=False).astype("u1").tobytes())
            docs_n, tokens = docs_n + len(sizes), int(ends[-1]) if len(ends) else tokens
        for k, stream in out.items():
            stream.close()
            if docs_n:
                store.move(names[k], f"{root}/part-{part:06d}.{k}")
            else:
                store.delete_file(names[k])
        yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int64()), "docs": pa.array([docs_n], pa.int64()), "tokens": pa.array([tokens], pa.int64())})

    pafs.FileSystem.from_uri(folder)[0].create_dir(pafs.FileSystem.from_uri(folder)[1], recursive=True)
    counts = sorted((r.part, r.docs, r.tokens) for r in ordered.mapInArrow(run, "part long, docs long, tokens long").collect() if r.docs)
    base, parts = 0, []
    for part, docs_n, tokens in counts:
        parts.append((part, base, docs_n, tokens))
        base += tokens
    return parts, dtype


def _mapped(store: pafs.FileSystem, name: str, dtype: str) -> np.ndarray:
    if isinstance(store, pafs.LocalFileSystem):
        return np.memmap(name, dtype, "r") if os.path.getsize(name) else np.zeros(0, dtype)
    with store.open_input_file(name) as f:
        return np.frombuffer(f.read_buffer(), dtype)


def read_tokens(spark: SparkSession, folder: str, parts: list[tuple[int, int, int, int]], dtype: str, keep_ids: bool = False) -> DataFrame:
    """One row per document from the files: doc_id, start, n_tokens, ids_crc32, and with `keep_ids` the ids."""
    extra = ", ids array<long>" if keep_ids else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for part, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                at = f"{root}/part-{part:06d}"
                ids, off, doc, null = (_mapped(store, f"{at}.{k}", t) for k, t in (("bin", dtype), ("off", "<u8"), ("doc", "<i8"), ("nul", "u1")))
                for a in range(0, len(doc), 5000):
                    edges = off[a : a + 5001].astype(np.int64)
                    own = [ids[x:y] for x, y in zip(edges, edges[1:], strict=False)]
                    out = {
                        "doc_id": pa.array(doc[a : a + 5000].astype(np.int64), mask=null[a : a + 5000].astype(bool)),
                        "start": pa.array(base + edges[:-1], pa.int64()),
                        "n_tokens": pa.array(np.diff(edges), pa.int64()),
                        "ids_crc32": pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in own], pa.int64()),
                    }
                    if keep_ids:
                        out["ids"] = pa.array([x.tolist() for x in own], pa.list_(pa.int64()))
                    yield pa.RecordBatch.from_pydict(out)

    rows = ",".join(f"({part}L,{base}L)" for part, base, _, _ in parts) or "(0L,0L)"
    index = spark.sql(f"SELECT * FROM VALUES {rows} AS t(part, base)").where(F.lit(bool(parts)))
    return index.repartition(max(1, len(parts)), "part").mapInArrow(run, f"doc_id long, start long, n_tokens long, ids_crc32 long{extra}")


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's result, read back from files written for all of `documents`."""
    import public_tokenizers

    folder = f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}"
    parts, dtype = write_tokens(load(spark, sf_dir, "documents"), folder, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return read_tokens(spark, folder, parts, dtype)
