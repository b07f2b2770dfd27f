"""Encoding a corpus with a public tokenizer (problem 6) by a table of its distinct words.

1. Documents are cut into the tokenizer's words, a block of documents at a time (split_words), and each block is written
   as its distinct words and, for every document, their numbers in order. 2. The words of all blocks make one table of
   distinct words, each of which is encoded once. 3. Its ids are joined back to the blocks' words and set in by position.
Decoding goes the same way, through a table of ids and pieces.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import written

#: Characters of a block; a longer document is a block of its own. A task holds one block.
BLOCK = 3_000_000
VOCABULARY = "byte_bpe_50k.tiktoken"
#: A fixed odd multiplier of the words' hashes; equal hashes are compared sign by sign.
ODD = 0x9E3779B97F4A7C15

SPACE, LETTER, DIGIT, OTHER, EDGE = 0, 1, 2, 3, 4


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encoder(path: str) -> Callable[[str], list[int]]:
    """From a word to its ids."""
    import base64

    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


_classes: list = []


def classes():
    """The class of every code point, by the tables of the regex library, which agree with the tokenizer's."""
    if not _classes:
        import numpy as np
        import regex

        every = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
        text = "".join(map(chr, every))
        of = np.full(0x110000, OTHER, np.uint8)
        for kind, pattern in ((SPACE, r"\s+"), (LETTER, r"\p{L}+"), (DIGIT, r"\p{N}+")):
            for m in regex.finditer(pattern, text):
                of[every[m.start()] : every[m.end() - 1] + 1][of[every[m.start()] : every[m.end() - 1] + 1] == OTHER] = kind
        of[0xD800:0xE000] = OTHER
        _classes.append(of)
    return _classes[0]


def word_starts(points, edges):
    """Where words start in text given as code points, by the tokenizer's rule:

    a run of letters, of digits or of other signs is a word, with the one space before it; white space before a run is a
    word without its last sign; an apostrophe alone and s, t, m, d, re, ve or ll after it are a word. edges: places of the
    signs that part texts; they belong to no word and are given as starts as well.
    """
    import numpy as np

    n = len(points)
    kind = classes()[points]
    kind[edges] = EDGE
    before = np.empty(n, np.uint8)
    before[0], before[1:] = EDGE, kind[:-1]
    turn = kind != before
    after = np.empty(n, np.uint8)
    after[-1], after[:-1] = EDGE, kind[1:]
    space = kind == SPACE
    blank = points == 32
    blank[edges] = False
    led = np.empty(n, bool)
    led[0], led[1:] = False, blank[:-1]
    starts = np.where(space, turn | ((after != SPACE) & (after != EDGE)), turn & ~led)
    starts[edges] = True
    at = np.flatnonzero((points == 39) & starts & (kind == OTHER) & (after == LETTER))
    if len(at):
        padded = np.concatenate([points, [0, 0]])
        one, two = padded[at + 1], padded[at + 2]
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
        for found, length in ((short, 2), (long & ~short, 3)):
            hit = at[found]
            starts[hit + 1] = False
            rest = hit + length
            rest = rest[rest < n]
            starts[rest[kind[rest] == LETTER]] = True
    return starts


def distinct_words(texts: list[str]) -> tuple[list[str], list]:
    """The different words of the texts, the more frequent first, and for each text the numbers of its words in order."""
    import numpy as np
    import pandas as pd

    joined = "\n".join(texts) + "\n"
    points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    edges = np.cumsum(lengths + 1) - 1
    starts = np.flatnonzero(word_starts(points, edges))
    ends = np.append(starts[1:], len(points))
    real = np.ones(len(starts), bool)
    real[np.searchsorted(starts, edges)] = False
    per_text = np.add.reduceat(real.astype(np.int64), np.searchsorted(starts, np.concatenate([[0], edges[:-1] + 1])))
    starts, ends = starts[real], ends[real]
    if not len(starts):
        return [], [np.zeros(0, np.uint32) for _ in texts]
    long = ends - starts
    inside = np.ones(len(points), bool)
    inside[edges] = False
    signs = points[inside]  # the words' signs, word after word
    firsts = (np.cumsum(long) - long).astype(np.int32)
    place = np.arange(len(signs), dtype=np.int32)
    place -= np.repeat(firsts, long)  # of a sign in its word
    with np.errstate(over="ignore"):
        powers = np.full(int(long.max()), ODD, np.uint64)
        powers[0] = 1
        np.cumprod(powers, out=powers)
        mixed = signs.astype(np.uint64)
        mixed *= np.uint64(0xD6E8FEB86659FD93)
        mixed ^= mixed >> np.uint64(31)
        mixed *= powers[place]
        hashes = np.add.reduceat(mixed, firsts)
        hashes ^= long.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    code, found = pd.factorize(hashes)
    first = np.flatnonzero(np.diff(np.maximum.accumulate(code), prepend=-1))
    rank = np.argsort(-np.bincount(code), kind="stable")
    number_of = np.empty(len(found), np.uint32)
    number_of[rank] = np.arange(len(found), dtype=np.uint32)
    code, first = number_of[code], first[rank]
    words = [joined[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist())]
    # proof that equal hashes were equal words
    same = bool((long == long[first][code]).all())
    if same:
        place += np.repeat(firsts[first][code], long)
        same = bool((signs == signs[place]).all())
    if not same:
        number: dict[str, int] = {}
        code = np.fromiter((number.setdefault(joined[a:b], len(number)) for a, b in zip(starts.tolist(), ends.tolist())), np.uint32, len(starts))
        words = list(number)
    return words, np.split(code, np.cumsum(per_text)[:-1])


BLOCKS = "block string, docs array<bigint>, counts array<int>, codes binary, words array<string>"


def _blocks(batches: Iterator) -> Iterator:
    """(doc, text) into blocks. A null text is an empty one."""
    import numpy as np
    import pyarrow as pa
    import zstandard
    from pyspark import TaskContext

    part, made, held, size = TaskContext.get().partitionId(), 0, [], 0
    press = zstandard.ZstdCompressor(level=3)

    def block() -> pa.RecordBatch:
        nonlocal made, held, size
        words, codes = distinct_words([t for _, t in held])
        flat = np.concatenate(codes) if codes else np.zeros(0, np.uint32)
        kind = np.uint16 if len(words) < 65_536 else np.uint32
        out = [f"{part}-{made}"], [[d for d, _ in held]], [[len(c) for c in codes]], [press.compress(flat.astype(kind).tobytes())], [words]
        made, held, size = made + 1, [], 0
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.string(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary(), pa.list_(pa.string())))], ["block", "docs", "counts", "codes", "words"])

    for batch in batches:
        for at in range(0, batch.num_rows, 100):
            part_of = batch.slice(at, 100)
            for doc, text in zip(part_of.column(0).to_pylist(), part_of.column(1).to_pylist()):
                text = text or ""
                if held and size + len(text) > BLOCK:
                    yield block()
                held.append((doc, text))
                size += len(text)
    if held:
        yield block()


def split_words(docs: DataFrame, doc: str, text: str) -> DataFrame:
    """Blocks of documents, written to the shared folder: read for their words, and again for their codes."""
    return written(docs.select(F.col(doc).cast("bigint").alias("doc"), F.col(text).alias("text")).mapInArrow(_blocks, BLOCKS), "blocks")


def _encoded(batches: Iterator, path: str, count_only: bool) -> Iterator:
    import numpy as np
    import pyarrow as pa

    encode = encoder(path)
    for batch in batches:
        ids = [encode(w) for w in batch.column(0).to_pylist()]
        n = np.fromiter(map(len, ids), np.int32, len(ids))
        if count_only:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n)], ["word", "n"])
        else:
            # packed: four bytes an id, a quarter of what a list of them takes in a shuffle
            flat = np.fromiter((i for x in ids for i in x), np.int32, int(n.sum()))
            ends = np.concatenate([[0], np.cumsum(4 * n)]).astype(np.int32)
            packed = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(flat.tobytes())])
            yield pa.RecordBatch.from_arrays([batch.column(0), packed], ["word", "ids"])


def _in_order(batch, k: int):
    """Of the k-th block: its documents, where each one's codes begin, the codes, and its words' answers by number."""
    import numpy as np
    import pyarrow as pa
    import zstandard

    docs, counts = (batch.column(i)[k].values.to_numpy() for i in (1, 2))
    edges = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])
    total = int(edges[-1])
    raw = zstandard.ZstdDecompressor().decompress(batch.column(3)[k].as_py(), max_output_size=max(1, 4 * total))
    codes = np.frombuffer(raw, np.uint16 if len(raw) == 2 * total else np.uint32)
    at, answers = batch.column(4)[k].values.flatten()
    return docs, edges, codes, answers.take(pa.array(np.argsort(at.to_numpy())))


def _set_in(batches: Iterator, count_only: bool) -> Iterator:
    """Blocks with their words' answers, into documents with their ids or the number of these."""
    import numpy as np
    import pyarrow as pa

    for batch in batches:
        for k in range(batch.num_rows):
            docs, edges, codes, answers = _in_order(batch, k)
            if count_only:
                sums = np.concatenate([[0], np.cumsum(answers.to_numpy().astype(np.int64)[codes])])
                yield pa.RecordBatch.from_arrays([pa.array(docs), pa.array(sums[edges[1:]] - sums[edges[:-1]])], ["doc", "n_tokens"])
                continue
            answers = answers.cast(pa.large_binary())
            offsets = np.frombuffer(answers.buffers()[1], np.int64)[answers.offset : answers.offset + len(answers) + 1] // 4
            ids = np.frombuffer(answers.buffers()[2] or b"", np.int32)
            each = np.diff(offsets)[codes].astype(np.int64)
            upto = np.concatenate([[0], np.cumsum(each)])
            place = np.arange(int(upto[-1]), dtype=np.int64) - np.repeat(upto[:-1] - offsets[:-1][codes], each)
            yield pa.RecordBatch.from_arrays([pa.array(docs), pa.ListArray.from_arrays(pa.array(upto[edges].astype(np.int32)), pa.array(ids[place], pa.int32()))], ["doc", "ids"])


def _answered(blocks: DataFrame, answer: str, kind: str, table: DataFrame) -> DataFrame:
    """(block, docs, counts, codes, answers): table's (word, answer) brought back to every block that holds the word.

    One shuffle by block carries both the answers and the codes. A block's answers are one list, no longer than its text.
    """
    words = blocks.select("block", F.posexplode("words").alias("at", "word"))
    rest = ("docs", "array<bigint>"), ("counts", "array<int>"), ("codes", "binary")
    none = F.lit(None).cast(f"struct<at:int,answer:{kind}>").alias("x")
    back = words.join(table, "word").select("block", F.struct("at", F.col(answer).alias("answer")).alias("x"), *(F.lit(None).cast(t).alias(c) for c, t in rest))
    rows = back.unionByName(blocks.select("block", none, *(c for c, _ in rest))).repartition("block")
    return rows.groupBy("block").agg(*(F.first(c, ignorenulls=True).alias(c) for c, _ in rest), F.collect_list("x").alias("answers"))


def word_table(blocks: DataFrame, path: str, count_only: bool) -> DataFrame:
    """Each different word of the corpus once, with its ids, packed, or only their number."""
    words = blocks.select(F.explode("words").alias("word")).distinct()
    return words.mapInArrow(lambda b: _encoded(b, path, count_only), "word string, " + ("n int" if count_only else "ids binary"))


def encode(docs: DataFrame, doc: str, text: str, path: str | None = None) -> DataFrame:
    """(doc, ids) of every row: the token ids of its whole text, special tokens read as ordinary text.

    Null and empty texts have an empty list. Rows are not merged: a doc that stands twice comes out twice. Other columns of
    docs are not read.
    """
    path = path or vocabulary_path()
    blocks = split_words(docs, doc, text)
    blocks = _answered(blocks, "ids", "binary", word_table(blocks, path, False))
    return blocks.mapInArrow(lambda b: _set_in(b, False), "doc bigint, ids array<int>").withColumnRenamed("doc", doc)


def count(docs: DataFrame, doc: str, text: str, path: str | None = None) -> DataFrame:
    """(doc, n_tokens): the same table of words, with nothing but the number of ids brought back."""
    path = path or vocabulary_path()
    blocks = split_words(docs, doc, text)
    blocks = _answered(blocks, "n", "int", word_table(blocks, path, True))
    return blocks.mapInArrow(lambda b: _set_in(b, True), "doc bigint, n_tokens bigint").withColumnRenamed("doc", doc)


# decoding


def _id_blocks(batches: Iterator) -> Iterator:
    """(doc, ids) into blocks of their distinct ids and the numbers of these in order, the layout of BLOCKS."""
    import numpy as np
    import pyarrow as pa
    import zstandard
    from pyspark import TaskContext

    part, press = TaskContext.get().partitionId(), zstandard.ZstdCompressor(level=3)
    made = 0
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            lists = batch.column(1)
            sizes = np.diff(lists.offsets.to_numpy())[: batch.num_rows]
            many = max(1, int(np.searchsorted(np.cumsum(sizes[at:]), BLOCK // 3)))
            some = batch.slice(at, many)
            flat = some.column(1).flatten().to_numpy()
            ids, codes = np.unique(flat, return_inverse=True)
            kind = np.uint16 if len(ids) < 65_536 else np.uint32
            out = [f"{part}-{made}"], [some.column(0).to_pylist()], [sizes[at : at + many].tolist()], [press.compress(codes.astype(kind).tobytes())], [ids.tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.string(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary(), pa.list_(pa.int32())))], ["block", "docs", "counts", "codes", "words"])
            at, made = at + many, made + 1


def _pieces(batches: Iterator) -> Iterator:
    """Like _set_in, with pieces of bytes: out come texts. A document without ids is an empty text."""
    import pyarrow as pa

    for batch in batches:
        for k in range(batch.num_rows):
            docs, edges, codes, answers = _in_order(batch, k)
            pieces, edges = answers.to_pylist(), edges.tolist()
            for i in range(0, len(docs), 64):
                texts = [b"".join([pieces[c] for c in codes[a:b].tolist()]).decode("utf-8", "replace") for a, b in zip(edges[i : i + 64], edges[i + 1 : i + 65])]
                yield pa.RecordBatch.from_arrays([pa.array(docs[i : i + 64]), pa.array(texts, pa.string())], ["doc", "text"])


def piece_table(spark, path: str | None = None) -> DataFrame:
    """(word, piece) of a vocabulary file: the id and its bytes. A vocabulary has a fixed size, 50,256 here."""
    lines = spark.read.text(f"file://{path or vocabulary_path()}").where("value <> ''")
    return lines.select(F.split("value", " ")[1].cast("int").alias("word"), F.unbase64(F.split("value", " ")[0]).alias("piece"))


def decode(encoded: DataFrame, doc: str, ids: str, path: str | None = None) -> DataFrame:
    """(doc, text): the pieces of the ids, joined by id, in order. Null and empty lists give an empty text; ids outside the vocabulary fail."""
    lists = encoded.select(F.col(doc).cast("bigint").alias("doc"), F.coalesce(F.col(ids), F.array().cast("array<int>")).alias("ids"))
    blocks = written(lists.mapInArrow(_id_blocks, BLOCKS.replace("words array<string>", "words array<int>")), "idblocks")
    blocks = _answered(blocks, "piece", "binary", F.broadcast(piece_table(encoded.sparkSession, path)))
    return blocks.mapInArrow(_pieces, "doc bigint, text string").withColumnRenamed("doc", doc)
