"""Token-id files: documents compressed one by one with a shared zstandard dictionary.

Ids of a document are unsigned 16-bit integers, or 32-bit ones when the vocabulary needs them; the file says which. A dictionary is trained on
the serialized ids of at most `sample_docs` documents of at most SAMPLE_BYTES of text, then every document is compressed alone against it, so a
short document can be read without its neighbours.

A file is: magic, width of ids, SHA-256 of the dictionary, frames one after the other, and an index of (doc_id, frame offset, frame size,
token count, tokens before it in this file) with its own offset in the last bytes. Files hold ascending ranges of doc_id. The dictionary
lies beside them, named by its hash; a reader refuses a file whose hash differs.

Documents are dealt to ranges by boundaries of doc_id that are taken from the id column alone; a range is cut into files of a bounded number
of bytes. Tasks write a file under a fresh name and move
it when it is whole, so a retried task only replaces it. Defined results: null and empty texts hold the end id alone; equal ids keep their
order by content; a null id sorts first; an empty table gives no files and no rows."""

from __future__ import annotations

import hashlib
import io
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import words as W
from tessera.llm.folders import filesystem, new_folder, put_bytes, stored
from tessera.llm.packing import SLICE_BYTES, worker_encoder

MAGIC = b"TOKD1\0"
INDEX = np.dtype([("doc_id", "<i8"), ("offset", "<i8"), ("size", "<i4"), ("n", "<i4"), ("before", "<i8")])
END = 1
NO_ID = np.iinfo(np.int64).min  # stands for a null id, which sorts first
SAMPLE_DOCS = 2_000  # documents that the dictionary is trained on
DICTIONARY_BYTES = 64 << 10
SAMPLE_BYTES = 64 << 10  # longest text of the sample
FILE_DOCS = 20_000  # documents per range
LEVEL = 3
FILE_BYTES = 128 << 20  # a file is closed beyond this size


def id_width(tokenizer_file: str) -> int:
    """Bytes that an id of the vocabulary needs."""
    from tokenizers import Tokenizer

    return 2 if Tokenizer.from_file(tokenizer_file).get_vocab_size() <= 1 << 16 else 4


def encoder(tokenizer_file: str, width: int, end: int = END):
    """A function from a text array to one serialized id array per text. A worker has one encoder with a cache of bounded size."""
    encode = worker_encoder(tokenizer_file, end)

    def serialize(texts: pa.Array) -> list[np.ndarray]:
        ids, at = encode(texts)
        ids = ids.astype(f"<u{width}")
        return [ids[a:b] for a, b in zip(at, at[1:])]

    return serialize


def train(docs: DataFrame, tokenizer_file: str, width: int, sample_docs: int = SAMPLE_DOCS, size: int = DICTIONARY_BYTES) -> bytes:
    """A zstandard dictionary from the serialized ids of at most `sample_docs` documents of bounded length, chosen by hash of their ids."""
    import zstandard

    def ids(batches):
        encode = encoder(tokenizer_file, width)
        for whole in batches:
            for batch in W.slices(whole, "text"):
                yield pa.record_batch([pa.array([x.tobytes() for x in encode(batch.column("text"))], pa.binary())], ["ids"])

    # the ids are chosen first, so that no text is sorted
    chosen = docs.select("doc").orderBy(F.expr("xxhash64(doc)"), "doc").limit(sample_docs).distinct()
    texts = docs.join(F.broadcast(chosen), "doc").filter(F.octet_length("text") <= SAMPLE_BYTES).select("text").limit(sample_docs)
    samples = [x for x in texts.mapInArrow(ids, "ids binary").toArrow()["ids"].to_pylist() if len(x) > 8]
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:  # too little to learn from: the samples themselves, as raw content
        return b"".join(samples)[:size]


def boundaries(docs: DataFrame, files: int) -> list[int]:
    """Ascending first ids of the files after the first, from the id column alone."""
    if files < 2:
        return []
    cuts = docs.select(F.expr(f"percentile_approx(doc, array({', '.join(str(i / files) for i in range(1, files))}), 100000)").alias("c")).first()[0]
    return sorted(set(cuts or []))


def write(docs: DataFrame, tokenizer_file: str, folder: str, id_col: str = "doc_id", text_col: str = "text", file_docs: int = FILE_DOCS) -> DataFrame:
    """Writes the files and returns their list: (file, part, uri, n_docs, n_tokens), ascending by file and part."""
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    total = docs.count()
    cuts = boundaries(docs, -(-total // file_docs))
    width = id_width(tokenizer_file)
    dictionary = train(docs, tokenizer_file, width)
    name = hashlib.sha256(dictionary).hexdigest()
    put_bytes(f"{folder}/{name}.dict", dictionary)
    shared = spark.sparkContext.broadcast((dictionary, np.array(cuts, np.int64)))

    def compress(batches):
        import zstandard

        words, cuts = shared.value
        known = zstandard.ZstdCompressionDict(words)
        known.precompute_compress(level=LEVEL)
        press = zstandard.ZstdCompressor(level=LEVEL, dict_data=known)
        encode = encoder(tokenizer_file, width)
        for whole in batches:
            for batch in W.slices(whole, "text", SLICE_BYTES):
                ids = encode(batch.column("text"))
                doc = batch.column("doc")
                file = np.searchsorted(cuts, doc.fill_null(NO_ID).to_numpy(), "right")
                yield pa.record_batch([pa.array(file.astype(np.int32)), doc, pa.array([len(x) for x in ids], pa.int32()), pa.array([press.compress(x.data.cast("B")) for x in ids], pa.binary())],
                                      ["file", "doc", "n", "frame"])

    frames = docs.mapInArrow(compress, "file int, doc long, n int, frame binary")
    dealt = frames.repartition(min(len(cuts) + 1, 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))), "file").sortWithinPartitions("file", "doc", "frame")

    def save(batches):
        now, part, body, rows = None, 0, None, []

        def close():
            index = np.array(rows, INDEX)
            at = body.tell()
            body.write(index.tobytes())
            body.write(struct.pack("<qq", at, len(rows)))
            uri = f"{folder}/{now:08d}-{part:04d}.tok"
            put_bytes(uri, body.getvalue())
            done = (now, part, uri, len(rows), int(index["n"].sum()))
            return pa.record_batch([pa.array([x], t) for x, t in zip(done, (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64()))], ["file", "part", "uri", "n_docs", "n_tokens"])

        for batch in batches:
            for file, doc, n, frame in zip(*(c.to_pylist() for c in batch.columns)):
                if rows and (file != now or body.tell() > FILE_BYTES):
                    yield close()
                    part, rows = part + 1 if file == now else 0, []
                if not rows:
                    now, body = file, io.BytesIO()
                    body.write(MAGIC + bytes([width]) + bytes.fromhex(name))
                rows.append((NO_ID if doc is None else doc, body.tell(), len(frame), n, rows[-1][4] + rows[-1][3] if rows else 0))
                body.write(frame)
        if rows:
            yield close()

    return stored(dealt.mapInArrow(save, "file int, part int, uri string, n_docs long, n_tokens long"), "token-files")


class TokenFile:
    """Random access to one file: reads the index once, then a frame per document."""

    def __init__(self, uri: str):
        import zstandard

        store, path = filesystem(uri)
        self.source = store.open_input_file(path)
        head = self.source.read_at(39, 0)
        if head[:6] != MAGIC:
            raise ValueError(f"{uri} is not a token file")
        with store.open_input_file(f"{path.rpartition('/')[0]}/{head[7:39].hex()}.dict") as f:
            words = f.read()
        if hashlib.sha256(words).digest() != head[7:39]:
            raise ValueError(f"{uri} needs another dictionary")
        self.width = head[6]
        size = self.source.size()
        at, n = struct.unpack("<qq", self.source.read_at(16, size - 16))
        self.index = np.frombuffer(self.source.read_at(n * INDEX.itemsize, at), INDEX)
        self.open = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(words)).decompress

    def ids(self, row: int) -> np.ndarray:
        r = self.index[row]
        return np.frombuffer(self.open(self.source.read_at(int(r["size"]), int(r["offset"]))), f"<u{self.width}")

    def find(self, doc_id: int) -> np.ndarray:
        """Ids of the first document of that id; KeyError if it is not here."""
        k = int(np.searchsorted(self.index["doc_id"], doc_id))
        if k == len(self.index) or self.index["doc_id"][k] != doc_id:
            raise KeyError(doc_id)
        return self.ids(k)


def _listing(spark, files: DataFrame) -> DataFrame:
    """(uri, base): the stored files, each with the number of ids before it, a file per partition. The list of files, one row each, is summed
    on the driver; documents are not."""
    rows = sorted(files.select("file", "part", "uri", "n_tokens").collect())
    starts = np.cumsum([0, *(r["n_tokens"] for r in rows)]).tolist()
    listing = pa.table({"uri": pa.array([r["uri"] for r in rows], pa.string()), "base": pa.array(starts[:-1], pa.int64())})
    return spark.createDataFrame(listing).repartition(max(1, len(rows)))


def _documents(batches):
    """(doc_id, start, n_tokens, ids) of the listed files."""
    for batch in batches:
        for uri, base in zip(*(c.to_pylist() for c in batch.columns)):
            f = TokenFile(uri)
            for i in range(0, len(f.index), 500):
                part = f.index[i:i + 500]
                yield pa.record_batch([pa.array(part["doc_id"], mask=part["doc_id"] == NO_ID), pa.array(part["before"] + base), pa.array(part["n"].astype(np.int64)),
                                       pa.array([f.ids(k).astype("<u4").tobytes() for k in range(i, i + len(part))], pa.binary())], ["doc_id", "start", "n_tokens", "ids"])


def _digested(batches):
    for batch in batches:
        crc = [zlib.crc32(x) for x in batch.column("ids").to_pylist()]
        yield pa.record_batch([*(batch.column(c) for c in ("doc_id", "start", "n_tokens")), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])


def read(spark, files: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids): every document of stored files, ids as 32-bit integers; `start` counts the ids of all documents before it."""
    return _listing(spark, files).mapInArrow(_documents, "doc_id long, start long, n_tokens long, ids binary")


def digests(spark, files: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document that the files give back, read and digested in one worker."""
    return _listing(spark, files).mapInArrow(lambda batches: _digested(_documents(batches)), "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, tokenizer_file: str) -> DataFrame:
    """Writes all documents and digests what the files give back."""
    files = write(docs, tokenizer_file, new_folder(docs.sparkSession, "tokens"))
    return digests(docs.sparkSession, files)
