"""Token-id files: canonical length-limited Huffman coding in independent blocks.

A file set is two Parquet tables. ``codebook`` has id and code length (canonical codes follow from these). ``blocks``
has one row for each block of whole documents: the ids' codes in one bit string, the bit offset of every
CHECKPOINT-th id, and the documents' ids and lengths. A block needs nothing but the codebook to be decoded, and inside
a block all checkpoints are decoded side by side. ``parts`` follow each other in ascending document order.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.common import deleted_at_end, discard, map_by_id, select_text, settle, shared_folder, shuffles_freed, width_for
from gridloom.llm.tokens import text_ids

#: Longest code, which is also the width of the decoding table's index.
MAX_BITS = 16
#: Ids between two bit offsets in a block, and ids after which a block ends.
CHECKPOINT, BLOCK_IDS = 256, 1 << 18


# --- the code ----------------------------------------------------------------------------------------------------


def code_lengths(counts: np.ndarray, limit: int = MAX_BITS) -> np.ndarray:
    """Optimal code lengths of at most ``limit`` bits by package-merge; 0 for ids that do not occur."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.uint8)
    if len(used) <= 1:
        out[used] = 1
        return out
    if len(used) > 1 << limit:
        raise ValueError("too many ids for the length limit")
    order = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[order].astype(np.float64)
    is_leaf, packages = [], np.empty(0)
    for _ in range(limit):
        weight = np.r_[leaves, packages]
        by = np.argsort(weight, kind="stable")
        is_leaf.append(by < len(leaves))
        weight = weight[by]
        packages = weight[: len(weight) // 2 * 2].reshape(-1, 2).sum(1)
    taken, lengths = 2 * len(leaves) - 2, np.zeros(len(leaves), np.int64)
    for level in reversed(is_leaf):
        n = int(level[:taken].sum())
        lengths[:n] += 1
        taken = 2 * (taken - n)
    out[order] = lengths
    return out


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """The code of each id: ids in order of (length, id) get consecutive codes."""
    codes = np.zeros(len(lengths), np.uint32)
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    code, width = 0, 0
    steps = np.bincount(lengths, minlength=MAX_BITS + 1)
    at = 0
    for width in range(1, len(steps)):
        code <<= 1
        n = int(steps[width])
        codes[order[at : at + n]] = np.arange(code, code + n)
        code, at = code + n, at + n
    return codes


def decoding_table(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every MAX_BITS-bit window the id whose code it starts with, and that code's length."""
    codes = canonical_codes(lengths)
    ids = np.zeros(1 << MAX_BITS, np.uint32)
    bits = np.zeros(1 << MAX_BITS, np.uint8)
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    spans = (1 << (MAX_BITS - lengths[order].astype(np.int64))).astype(np.int64)
    first = codes[order].astype(np.int64) << (MAX_BITS - lengths[order].astype(np.int64))
    if len(order):
        ids[first[0] : first[-1] + spans[-1]] = np.repeat(order, spans)
        bits[first[0] : first[-1] + spans[-1]] = np.repeat(lengths[order], spans)
    return ids, bits


def encode_block(ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The bit string of ids and the bit offset of every CHECKPOINT-th one."""
    width = lengths[ids].astype(np.int64)
    ends = np.cumsum(width)
    start = ends - width
    total = int(ends[-1]) if len(ends) else 0
    # a code lies in at most two 32-bit words; codes do not overlap, so sums of their parts are the words
    place = codes[ids].astype(np.uint64) << (64 - width - (start & 31)).astype(np.uint64)
    word, n = start >> 5, (total >> 5) + 3
    words = np.bincount(word, (place >> np.uint64(32)).astype(np.float64), n)
    words += np.bincount(word + 1, (place & np.uint64(0xFFFFFFFF)).astype(np.float64), n)
    return words.astype(">u4").tobytes(), start[::CHECKPOINT].astype(np.uint32)


def decode_block(payload: bytes, n: int, checkpoints: np.ndarray, table: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """All lanes between two checkpoints advance together, a table look-up for each id."""
    ids, bits = table
    raw = np.frombuffer(payload, np.uint8).astype(np.uint32)
    raw = np.r_[raw, np.zeros(8, np.uint32)]
    windows = (raw[:-2] << 16) | (raw[1:-1] << 8) | raw[2:]
    at = checkpoints.astype(np.int64)
    out = np.empty((CHECKPOINT, len(at)), np.uint32)
    last = len(windows) - 1
    for step in range(min(CHECKPOINT, n)):
        look = (windows[np.minimum(at >> 3, last)] >> (8 - (at & 7)).astype(np.uint32)) & 0xFFFF
        out[step] = ids[look]
        at += bits[look]
    return out.T.reshape(-1)[:n]


# --- on Spark ----------------------------------------------------------------------------------------------------

_BLOCKS = (
    "part int, block int, part_start long, n_ids long, checkpoints binary, payload binary, doc_ids array<string>, doc_lengths array<int>"
)


def encode_documents(
    df: DataFrame, tokenizer: str, kind: str = "word", end_id: int | None = 2, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, uid and the ids of each whole text (16 bits each, enough for 65,536 ids), written once."""
    docs = select_text(df, id_col, text_col).withColumn("uid", F.monotonically_increasing_id())
    end = b"" if end_id is None else int(end_id).to_bytes(4, "little")

    def run(batches):
        encode = text_ids(tokenizer, kind)
        for pdf in batches:
            ids = [np.frombuffer(encode(t) + end, "<u4") for t in pdf["text"]]
            if max((x.max() for x in ids if len(x)), default=0) >= 1 << 16:
                raise ValueError("ids of more than 16 bits")
            pdf["ids"] = [x.astype("<u2").tobytes() for x in ids]
            yield pdf[["doc_id", "uid", "ids"]]

    return settle(map_by_id(docs, run, "uid long, ids binary"), "ids")


def write_id_file(ids: DataFrame, path: str) -> None:
    """Write the ids (doc_id, uid, ids of 16 bits) as a file set, in ascending order of doc_id, repeated ids by uid."""
    spark = ids.sparkSession

    def count(batches):
        total = np.zeros(1 << 16, np.int64)
        for pdf in batches:
            total += np.bincount(np.frombuffer(b"".join(pdf["ids"]), "<u2"), minlength=1 << 16)
        seen = np.flatnonzero(total)
        yield pd.DataFrame({"id": seen, "n": total[seen]})

    # at most one row for each id of the vocabulary
    counted = ids.select("ids").mapInPandas(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(1 << 16, np.int64)
    counts[counted["id"].to_numpy(int)] = counted["n"].to_numpy(int)
    lengths = code_lengths(counts)
    codes = canonical_codes(lengths)
    seen = np.flatnonzero(lengths)
    book = pd.DataFrame({"id": seen.astype("int32"), "bits": lengths[seen].astype("int32")})
    spark.createDataFrame(book, "id int, bits int").coalesce(1).write.parquet(f"{path}/codebook")

    def encode(batches):
        part, block, done = TaskContext.get().partitionId(), 0, 0
        held: list[tuple] = []
        size = 0

        def flush():
            all_ids = np.frombuffer(b"".join(h[1] for h in held), "<u2")
            payload, marks = encode_block(all_ids, codes, lengths)
            return pd.DataFrame(
                {
                    "part": [part],
                    "block": [block],
                    "part_start": [done],
                    "n_ids": [len(all_ids)],
                    "checkpoints": [marks.tobytes()],
                    "payload": [payload],
                    "doc_ids": [[h[0] for h in held]],
                    "doc_lengths": [[len(h[1]) // 2 for h in held]],
                }
            )

        for pdf in batches:
            for doc_id, own in zip(pdf["doc_id"], pdf["ids"], strict=True):
                held.append((doc_id, own))
                size += len(own) // 2
                if size >= BLOCK_IDS:
                    yield flush()
                    held, block, done, size = [], block + 1, done + size, 0
        if held:
            yield flush()

    id_type = ids.schema["doc_id"].dataType.simpleString()
    width = width_for(spark, 2 * int(counts.sum()))
    ordered = ids.repartitionByRange(width, "doc_id", "uid").sortWithinPartitions("doc_id", "uid")
    # ids are strings on the way through pandas, which would round large integers beside nulls
    blocks = ordered.select(F.col("doc_id").cast("string").alias("doc_id"), "ids").mapInPandas(encode, _BLOCKS)
    blocks = blocks.withColumn("doc_ids", F.col("doc_ids").cast(f"array<{id_type}>"))
    # the payload is dense already
    with shuffles_freed(spark):
        blocks.write.option("compression", "uncompressed").parquet(f"{path}/blocks")


def read_id_file(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """Read a file set back: doc_id, start (ids of all documents before it), n_tokens, ids_crc32 and, if asked, ids."""
    book = spark.read.parquet(f"{path}/codebook").toPandas()  # at most one row for each id of the vocabulary
    lengths = np.zeros(1 << 16, np.uint8)
    lengths[book["id"].to_numpy(int)] = book["bits"].to_numpy(int)
    blocks = spark.read.parquet(f"{path}/blocks")
    # a row for each task that wrote
    totals = sorted(map(tuple, blocks.groupBy("part").agg(F.sum("n_ids")).collect()))
    before = dict(zip((p for p, _ in totals), np.cumsum([0] + [n for _, n in totals]).tolist(), strict=False))
    id_type = blocks.schema["doc_ids"].dataType.elementType.simpleString()

    def run(batches):
        table = decoding_table(lengths)
        for pdf in batches:
            for row in pdf.itertuples():
                ids = decode_block(row.payload, row.n_ids, np.frombuffer(row.checkpoints, np.uint32), table).astype("<u4")
                size = np.asarray(row.doc_lengths, np.int64)
                ends = np.cumsum(size)
                raw = [ids[e - s : e].tobytes() for s, e in zip(size, ends, strict=True)]
                out = pd.DataFrame(
                    {
                        "doc_id": row.doc_ids,
                        "start": before[row.part] + row.part_start + ends - size,
                        "n_tokens": size,
                        "ids_crc32": [zlib.crc32(x) for x in raw],
                    }
                )
                if with_ids:
                    out["ids"] = raw
                yield out

    schema = "doc_id string, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids
    named = blocks.withColumn("doc_ids", F.col("doc_ids").cast("array<string>"))
    return named.mapInPandas(run, schema).withColumn("doc_id", F.col("doc_id").cast(id_type))


def id_file_round_trip(
    df: DataFrame, tokenizer: str, kind: str = "word", end_id: int | None = 2, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Encode every whole text, write the ids as a file set in ascending doc_id order and describe what is read back.

    A null or empty text is the end id alone. A null doc_id comes first. Rows with one doc_id keep the order in which
    they were read. An empty table gives empty files and an empty result. Other columns are ignored.
    """
    path = f"{shared_folder(df.sparkSession)}/id-file-{uuid.uuid4().hex}"
    deleted_at_end(df.sparkSession, path)
    ids = encode_documents(df, tokenizer, kind, end_id, id_col, text_col)
    write_id_file(ids, path)
    discard(ids)
    return read_id_file(df.sparkSession, path)
