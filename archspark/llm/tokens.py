"""Token ids of a corpus as binary files: shared static tables, independent blocks, checkpoints and checksums.

1. Texts are tokenised once, where they are read; ids go to a written table. Words that recur are looked up in a bounded cache.
2. Ids are counted over the whole corpus; the counts give one shared coding table.
3. Documents are range-partitioned by id; each task writes one file. Its blocks are coded independently.
4. Readers take runs of blocks. A run owns the documents that start in it and reads on until the last one ends.

File: header (magic, version, table checksum), blocks, directory, directory length and checksum, magic. The directory holds, as
checkpoints, the place, size, id count and checksum of every block, and the documents' ids and lengths. Files get their final
name when they are complete, and a task that runs again writes the same bytes.

Defined results: null text counts as empty; an empty text is the end id alone; a null document id comes first;
rows that repeat an id are documents of their own, in the order of their ids' bytes; an empty table gives no files and no rows.
"""

from __future__ import annotations

import functools
import json
import re
import string
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from archspark.llm.common import open_fs, shared_folder, slices, staged
from archspark.llm.rans import BLOCK, Table, decode_block, encode_block

MAGIC = b"ATOK0001"
END_ID = 0
CACHE_WORDS = 900_000
FILE_BYTES = 24 << 20
#: A single space between two other characters: the byte-level pre-tokenizer always cuts before it.
_CUT = re.compile(r"(?<=\S) (?=\S)").split
_BLANK = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_ODD = rf" {_BLANK}|{_BLANK} |\A | \z"
_MARKS = "".join(c for c in string.punctuation if c != "'")  # an apostrophe may begin a token with letters


def byte_letters() -> dict[int, str]:
    """Byte-level BPE's letter for each byte: printable Latin-1 stands for itself, the others follow from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


class WordEncoder:
    """Ids of whole texts from ids of words, for byte-level BPE files whose pre-tokenizer cuts before single spaces.

    Each word keeps the space before it, so no merge crosses a cut and the ids are those of the whole text. Letters followed by
    marks, and lines that meet in a word, are cut there as the pre-tokenizer does, and the pieces go to the library's merges at
    once; anything else goes through the whole tokenizer.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.size = self.tokenizer.get_vocab_size()
        if self.size > 1 << 16:
            raise ValueError("ids must fit 16 bits")
        self.bare = Tokenizer.from_file(path)  # merges only
        self.bare.pre_tokenizer = None
        self.letters = byte_letters()
        self.line_end = self.bare.token_to_id(self.letters[10])
        self.cache: dict[str, bytes] = {}

    def _lettered(self, text: str) -> str:
        return text.encode().decode("latin-1").translate(self.letters)

    def _merged(self, piece: str) -> bytes:
        return np.array(self.bare.encode(self._lettered(piece), add_special_tokens=False).ids, np.uint16).tobytes()

    def _learn(self, cores: list[str]) -> None:
        """Merge words of letters, some at a time; no merge crosses a line end that letters or a space follow."""
        for at in range(0, len(cores), 200):
            part = cores[at : at + 200]
            joined = self._lettered(" " + "\n ".join(part))
            ids = np.array(self.bare.encode_batch_fast([joined], add_special_tokens=False)[0].ids, np.uint16)
            ends = np.flatnonzero(ids == self.line_end)
            data, starts, ends = ids.tobytes(), [0, *(2 * ends + 2).tolist()], [*(2 * ends).tolist(), 2 * len(ids)]
            self.cache.update((w, data[a:b]) for w, a, b in zip(part, starts, ends, strict=True))

    def _known(self, piece: str) -> bytes:
        """Ids of a piece that the pre-tokenizer leaves whole."""
        found = self.cache.get(key := piece[1:] if piece[0] == " " else "\n" + piece)
        if found is None:
            found = self.cache[key] = self._merged(piece)
        return found

    def _line(self, line: str) -> bytes | None:
        """A space or nothing, letters, and marks or nothing; None for anything else."""
        core = line.rstrip(_MARKS)
        letters = core.removeprefix(" ")
        if not letters and len(line) > len(core):
            return self._known(line)
        if not letters.isalpha():
            return None
        return self._known(core) if len(core) == len(line) else self._known(core) + self._known(line[len(core) :])

    def _chunk(self, chunk: str) -> bytes:
        """Ids of text without blanks but a first space."""
        parts = [self._line(x) if x else None for x in chunk.split("\n")]
        return np.array(self.tokenizer.encode(chunk, add_special_tokens=False).ids, np.uint16).tobytes() if None in parts else self._known("\n").join(parts)

    def _word(self, word: str) -> bytes:
        """Ids of a space and the word."""
        if (core := word.rstrip(_MARKS)).isalpha():
            out = self._known(" " + core) + self._known(word[len(core) :])
        else:
            out = self._chunk(" " + word)
            if "\n" in word:  # lines meet in endless ways
                return out
        self.cache[word] = out
        return out

    def _words(self, words: list[str]) -> list[bytes]:
        """Ids of a space and each word, for distinct words."""
        if len(self.cache) > CACHE_WORDS:
            self.cache.clear()
        get, word = self.cache.get, self._word
        found = list(map(get, words))
        new = [w for w, b in zip(words, found) if b is None]
        cores = {w if w.isalpha() else w.partition("\n")[0].rstrip(_MARKS) for w in new}
        self._learn([c for c in cores if c.isalpha() and c not in self.cache])
        return [get(w) or word(w) if b is None else b for w, b in zip(words, found)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian 16-bit ids of each text; equal words of the texts are looked up once."""
        column = pa.array(texts, pa.string())
        is_odd = pc.match_substring_regex(column, _ODD)
        odd, even = is_odd.to_pylist(), column.filter(pc.invert(is_odd))
        words = pc.split_pattern(even, " ")
        coded = words.flatten().dictionary_encode()
        entries = self._words(coded.dictionary.to_pylist()) if len(even) else []
        starts = words.offsets.to_numpy()
        at = coded.indices.to_numpy().astype(np.int64)
        at[starts[:-1]] = len(entries) + np.arange(len(even))  # the first word has no space before it
        entries += [self._chunk(x) if x else b"" for x in (t.partition(" ")[0] for t in even.to_pylist())]
        flat = np.frombuffer(b"".join(entries), np.uint16)
        sizes = np.fromiter(map(len, entries), np.int64, len(entries)) // 2
        own = sizes[at]
        ends = np.cumsum(own)
        place = np.repeat((np.cumsum(sizes) - sizes)[at] - (ends - own), own) + np.arange(ends[-1] if len(ends) else 0)
        ids = flat[place]
        cuts = np.concatenate(([0], ends))[starts].tolist()
        done = iter([ids[a:b].tobytes() for a, b in zip(cuts, cuts[1:])])
        return [self._odd(t) if o else next(done) for t, o in zip(texts, odd)]

    def _odd(self, text: str) -> bytes:
        first, *rest = _CUT(text)
        return (self._chunk(first) if first else b"") + b"".join(self._words(rest))


@functools.cache
def encoder(path: str) -> WordEncoder:
    """One per Python worker."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return WordEncoder(path)


def tokenise(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Written table (id, n, ids): ids are compressed 16-bit numbers, the end id included."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        pack = zstandard.ZstdCompressor(1).compress
        end = np.array([END_ID], np.uint16).tobytes()
        for part in slices(batches, 512):
            coded = [b + end for b in encoder(path).encode([t or "" for t in part.column(1).to_pylist()])]
            sizes = pa.array([len(b) // 2 for b in coded], pa.int64())
            yield pa.RecordBatch.from_arrays([part.column(0), sizes, pa.array([pack(b) for b in coded], pa.binary())], ["id", "n", "ids"])

    return staged(rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, n bigint, ids binary"), "token-ids")


def unpacked(column: pa.Array) -> list[np.ndarray]:
    import zstandard

    unpack = zstandard.ZstdDecompressor().decompress
    return [np.frombuffer(unpack(b), np.uint16) for b in column.to_pylist()]


def count_ids(ids: DataFrame, size: int) -> np.ndarray:
    """Occurrences of each id over the corpus; the vocabulary bounds what reaches the driver."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for part in slices(batches):
            total += np.bincount(np.concatenate(unpacked(part.column(0))), minlength=size)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["token", "n"])

    counts = np.zeros(size, np.int64)
    for row in ids.select("ids").mapInArrow(run, "token bigint, n bigint").groupBy("token").agg(F.sum("n").alias("n")).collect():
        counts[row["token"]] = row["n"]
    return counts


class FileWriter:
    """Blocks of one file, written as they fill."""

    def __init__(self, out, table: Table):
        self.out, self.table = out, table
        self.held: list[np.ndarray] = []
        self.n = 0
        self.blocks: list[tuple[int, int, int, int]] = []
        self.at = out.write(MAGIC + struct.pack("<I", table.checksum))
        self.keys: list = []
        self.sizes: list[int] = []

    def add(self, key, ids: np.ndarray) -> None:
        self.keys.append(key)
        self.sizes.append(len(ids))
        self.held.append(ids)
        self.n += len(ids)
        if self.n >= BLOCK:
            whole = np.concatenate(self.held)
            for at in range(0, len(whole) - BLOCK + 1, BLOCK):
                self._block(whole[at : at + BLOCK])
            self.held = [whole[len(whole) // BLOCK * BLOCK :]]
            self.n = len(self.held[0])

    def _block(self, ids: np.ndarray) -> None:
        data = encode_block(ids, self.table)
        self.blocks.append((self.at, len(data), len(ids), zlib.crc32(data)))
        self.at += self.out.write(data)

    def finish(self) -> None:
        if self.n:
            self._block(np.concatenate(self.held))
        directory = zlib.compress(json.dumps({"blocks": self.blocks, "ids": self.keys, "sizes": self.sizes}).encode())
        self.out.write(directory + struct.pack("<II", len(directory), zlib.crc32(directory)) + MAGIC)


def read_directory(source, size: int) -> dict:
    source.seek(size - 16)
    tail = source.read(16)
    length, checksum = struct.unpack("<II", tail[:8])
    source.seek(size - 16 - length)
    data = source.read(length)
    if tail[8:] != MAGIC or zlib.crc32(data) != checksum:
        raise ValueError("directory is damaged")
    return json.loads(zlib.decompress(data))


def write_token_files(docs: DataFrame, folder: str, path: str, id_col: str = "doc_id", text_col: str = "text", file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write the corpus; returns the written manifest (file, path, docs, tokens, blocks, size), one row per file."""
    spark = docs.sparkSession
    ids = tokenise(docs, path, id_col, text_col)
    table = Table.from_counts(count_ids(ids, encoder(path).size))
    fs, base = open_fs(folder)
    fs.create_dir(base, recursive=True)
    with fs.open_output_stream(f"{base}/table.bin") as out:
        out.write(table.to_bytes())
    total = ids.agg(F.coalesce(F.sum(F.octet_length("ids")), F.lit(0))).first()[0]
    sent = spark.sparkContext.broadcast(table.to_bytes())

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId()
        fs, base = open_fs(folder)
        name, writer = f"{base}/.{number:06d}-{uuid.uuid4().hex}.tmp", None
        for part in slices(batches, 64):
            for key, own in zip(part.column(0).to_pylist(), unpacked(part.column(2))):
                if writer is None:
                    writer = FileWriter(fs.open_output_stream(name), Table.from_bytes(sent.value))
                writer.add(key, own)
        if writer:
            writer.finish()
            writer.out.close()
            fs.move(name, f"{base}/{number:06d}.tok")
            size = fs.get_file_info(f"{base}/{number:06d}.tok").size
            cells = [number, f"{number:06d}.tok", len(writer.keys), sum(writer.sizes), len(writer.blocks), size]
            yield pa.RecordBatch.from_pydict(dict(zip(("file", "name", "docs", "tokens", "blocks", "size"), ([c] for c in cells))))

    ordered = ids.repartitionByRange(max(1, -(-total // file_bytes)), "id").sortWithinPartitions("id", "ids")
    return staged(ordered.mapInArrow(run, "file bigint, name string, docs bigint, tokens bigint, blocks bigint, size bigint"), "token-manifest")


def read_token_files(spark: SparkSession, folder: str, manifest: DataFrame, id_type: str = "bigint", run_blocks: int = 16) -> DataFrame:
    """One row per document from the files: id, start (ids of all documents before it), n_tokens, ids (binary, 32-bit)."""
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    runs = manifest.withColumn("base", F.coalesce(F.sum("tokens").over(before), F.lit(0)))
    runs = runs.withColumn("first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1, F.lit(run_blocks).cast("long"))))
    n = manifest.agg(F.sum(F.ceil(F.col("blocks") / run_blocks))).first()[0] or 1  # tasks; else adaptive execution joins small rows
    runs = runs.select("name", "size", "base", "first").repartitionByRange(n, "name", "first")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = open_fs(folder)
        table = None
        for batch in batches:
            for row in batch.to_pylist():
                if table is None:
                    with fs.open_input_stream(f"{base}/table.bin") as f:
                        table = Table.from_bytes(f.read())
                with fs.open_input_file(f"{base}/{row['name']}") as f:
                    yield from read_run(f, row, run_blocks, table)

    return runs.mapInArrow(run, f"id {id_type}, start bigint, n_tokens bigint, ids binary")


def read_run(source, row: dict, run_blocks: int, table: Table) -> Iterator[pa.RecordBatch]:
    if source.read(12) != MAGIC + struct.pack("<I", table.checksum):
        raise ValueError("file and table don't belong together")
    directory = read_directory(source, row["size"])
    blocks, sizes = directory["blocks"], np.array(directory["sizes"], np.int64)
    starts = np.cumsum(sizes) - sizes
    block_ends = np.cumsum([b[2] for b in blocks])
    low = int(block_ends[row["first"] - 1]) if row["first"] else 0
    high = int(block_ends[min(row["first"] + run_blocks, len(blocks)) - 1])
    held, at, next_block = np.zeros(0, np.uint32), low, row["first"]
    own = np.flatnonzero((starts >= low) & (starts < high))
    for chunk in np.array_split(own, max(1, len(own) // 512)):
        if not len(chunk):
            continue
        pieces = []
        for doc in chunk:
            s, e = int(starts[doc]), int(starts[doc] + sizes[doc])
            fresh = [held]
            while next_block < len(blocks) and block_ends[next_block] - blocks[next_block][2] < e:
                place, size, n, checksum = blocks[next_block]
                source.seek(place)
                data = source.read(size)
                if zlib.crc32(data) != checksum:
                    raise ValueError("block is damaged")
                fresh.append(decode_block(data, n, table))
                next_block += 1
            held, at = (np.concatenate(fresh) if len(fresh) > 1 else held)[s - at :], s
            pieces.append(held[: e - s].astype("<u4").tobytes())
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([directory["ids"][d] for d in chunk]),
                pa.array(starts[chunk] + row["base"]),
                pa.array(sizes[chunk]),
                pa.array(pieces, pa.binary()),
            ],
            ["id", "start", "n_tokens", "ids"],
        )


def token_corpus(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None) -> DataFrame:
    """Write the files (to a new shared folder unless one is named) and read them back."""
    folder = folder or shared_folder(docs.sparkSession, "token-files")
    manifest = write_token_files(docs, folder, path, id_col, text_col)
    return read_token_files(docs.sparkSession, folder, manifest, docs.schema[id_col].dataType.simpleString())
