"""Cross-tokenizer alignment: distinct segments are tokenised and aligned once, documents are composed of them."""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import Scratch, slices
from .tokens import refuse_other_splits, tokenizer_file

#: SentencePiece's sign for a space.
SPACE = "▁"
#: Kinds of entries in a SentencePiece file.
NORMAL, USER_DEFINED, UNUSED, BYTE = 1, 4, 5, 6
#: Every character that some Unicode version counts as white space, or counted once, beside BORDERS.
DOUBTFUL = "\x0b\x0c\r\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200b\u2028\u2029\u202f\u205f\u3000\ufeff"
#: White space before which a segment may begin.
BORDERS = " \t\n"
#: Alone before a segment it stands for the text before it, as no entry of B holds it.
GUARD = "\n"

FACTS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]
#: Segments in a row that are tokenised as one string, and the most pairs of ids that are broadcast (16 bytes each).
TOGETHER, MOST_PAIRS = 1024, 4_000_000
#: Bytes of joined rows that a task packs together.
PACK_BYTES = 16 << 20


def segments(text: str) -> list[str]:
    """The text cut before each run of white space that begins with one of BORDERS and follows a character that surely is none."""
    found = _SEGMENT.findall(text)
    found.pop()  # the empty match at the end
    return found


#: What may end a segment that is tokenised alone.
_NOT_SURE = frozenset(c for c in map(chr, range(0x10000)) if re.match(f"[{BORDERS}{DOUBTFUL}]", c))
_SEGMENT = re.compile(f"[{BORDERS}]*[^{BORDERS}{DOUBTFUL}]*(?:[{DOUBTFUL}][{BORDERS}{DOUBTFUL}]*[^{BORDERS}{DOUBTFUL}]*)*")


def piece_file(path: str | None = None) -> bytes:
    """A SentencePiece file; by default piece_bpe_32k.model."""
    import public_tokenizers

    with open(path or public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        return f.read()


def refuse_other_pieces(model: bytes) -> list[bytes]:
    """The bytes of B's entries. Raises unless the file proves that segments can be tokenised alone.

    BPE joins neighbours only to entries, so nothing grows across a border if no entry holds a character
    that isn't white space followed by one of BORDERS. No entry may hold GUARD. Texts must come back
    unchanged but for SPACE: no normalizer, a space before the text, all 256 bytes to fall back on.
    """
    from sentencepiece import sentencepiece_model_pb2 as pb

    spec = pb.ModelProto()
    spec.ParseFromString(model)
    n, t = spec.normalizer_spec, spec.trainer_spec
    texts = [p.piece for p in spec.pieces if p.type in (NORMAL, USER_DEFINED, UNUSED)]
    crossing = re.compile(f"[^{BORDERS}{DOUBTFUL}{SPACE}][{BORDERS}{SPACE}]")
    lossless = n.name == "identity" and not n.precompiled_charsmap and n.add_dummy_prefix and not n.remove_extra_whitespaces and n.escape_whitespaces and t.byte_fallback
    if not lossless or t.treat_whitespace_as_suffix or t.model_type != t.BPE or sum(p.type == BYTE for p in spec.pieces) != 256 or any(p.type == USER_DEFINED for p in spec.pieces):
        raise ValueError("this model may change texts or takes words of its own")
    if any(crossing.search(x) or GUARD in x for x in texts):
        raise ValueError("this model has entries that reach across the borders of segments")
    return [bytes([int(p.piece[3:5], 16)]) if p.type == BYTE else p.piece.replace(SPACE, " ").encode() for p in spec.pieces]


def byte_letters() -> dict[str, int]:
    """The letter that byte-level vocabularies write for each byte: itself if it prints, else the next one from 256 on."""
    prints = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in prints]
    return {chr(b): b for b in prints} | {chr(256 + i): b for i, b in enumerate(rest)}


class Aligner:
    """Both tokenizers of one worker."""

    def __init__(self, model_a: str, model_b: bytes):
        import os

        import numpy as np

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(model_a)
        self.a.no_truncation()
        self.a.no_padding()
        self.a.encode_special_tokens = True
        letter = byte_letters()
        added = {t.content for t in self.a.get_added_tokens_decoder().values()}
        self.bytes_a = {i: w.encode() if w in added else bytes(letter[c] for c in w) for w, i in self.a.get_vocab().items()}
        self.b = SentencePieceProcessor(model_proto=model_b)
        self.bytes_b = dict(enumerate(refuse_other_pieces(model_b)))
        self.skip = len(self.b.encode(GUARD))
        self.sizes = [np.zeros(max(t) + 1, np.int64) for t in (self.bytes_a, self.bytes_b)]
        for size, table in zip(self.sizes, (self.bytes_a, self.bytes_b)):
            for k, v in table.items():
                size[k] = len(v)

    def encode(self, text: str) -> tuple[list[int], list[int]]:
        """The ids of both for a segment, or several in a row, as they are within a text. Raises if bytes change."""
        a, b = self.a.encode(text, add_special_tokens=False).ids, self.b.encode(GUARD + text)[self.skip :]
        for ids, table in ((a, self.bytes_a), (b, self.bytes_b)):
            if b"".join([table[i] for i in ids]) != text.encode():
                raise ValueError(f"a segment changed in a tokenizer: {text[:80]!r}")
        return a, b

    def align(self, texts: list[str]) -> Iterator[Alignment]:
        """The alignment of each segment. Those that end with what surely isn't white space are cut off again behind it, so
        neighbours are tokenised as one string."""
        run: list[str] = []
        for t in texts:
            run.append(t)
            if len(run) >= TOGETHER or t[-1] in _NOT_SURE:
                yield from self._aligned(run)
                run = []
        if run:
            yield from self._aligned(run)

    def _aligned(self, run: list[str]) -> Iterator[Alignment]:
        import numpy as np

        a, b = (np.array(x, np.int32) for x in self.encode("".join(run)))
        ends_a, ends_b = np.cumsum(self.sizes[0][a]), np.cumsum(self.sizes[1][b])
        each = np.union1d(ends_a, ends_b)  # a pair of tokens overlaps in exactly one stretch between these
        link_a, link_b = a[np.searchsorted(ends_a, each)], b[np.searchsorted(ends_b, each)]
        both = np.intersect1d(ends_a, ends_b, assume_unique=True)
        at_a, at_b = (np.concatenate([[0], np.searchsorted(e, both) + 1]).tolist() for e in (ends_a, ends_b))
        of_segment = np.cumsum([len(t.encode()) for t in run])
        groups = np.searchsorted(both, of_segment) + 1
        links = np.searchsorted(each, of_segment) + 1
        names_a, names_b = list(map(str, a.tolist())), list(map(str, b.tolist()))
        pieces = [f"{','.join(names_a[i:k])}|{','.join(names_b[j:m])}" for i, k, j, m in zip(at_a, at_a[1:], at_b, at_b[1:])]
        g = n = 0
        for to_g, to_n in zip(groups.tolist(), links.tolist()):
            yield Alignment(at_a[to_g] - at_a[g], at_b[to_g] - at_b[g], to_g - g, ";".join(pieces[g:to_g]), link_a[n:to_n], link_b[n:to_n])
            g, n = to_g, to_n


class Alignment(NamedTuple):
    """Tokens of A and B, groups and their ids as `a1,a2|b1;a3|b2,b3`, and the two sides of the links."""

    n_a: int
    n_b: int
    n_groups: int
    groups: str
    a: object
    b: object


@lru_cache(1)
def _worker(models: tuple[str, bytes]) -> Aligner:
    return Aligner(*models)


def _empty(text: str | None) -> bool:
    """Whether a text has no tokens: B gives SPACE back as a space, and everything else as it was."""
    return not text or SPACE in text


def _in_blocks(docs: DataFrame, size: int) -> DataFrame:
    """(block, docs binary): neighbours of a task whose texts are about `size` bytes together, as a compressed Arrow stream of docs(doc_id, text)."""

    def pack(held: list):
        import pyarrow as pa

        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, held[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            out.write_table(pa.Table.from_batches(held).combine_chunks())
        return pa.array([sink.getvalue().to_pybytes()], pa.binary())

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        number, held, filled = TaskContext.get().partitionId() << 32, [], 0
        for b in slices(batches, 64):
            held.append(b)
            filled += b.nbytes
            if filled >= size:
                yield pa.RecordBatch.from_arrays([pa.array([number]), pack(held)], ["block", "docs"])
                number, held, filled = number + 1, [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([number]), pack(held)], ["block", "docs"])

    return docs.mapInArrow(run, "block long, docs binary")


def _documents(pack: bytes):
    """Batches of (doc_id, text) of a block, a few rows each."""
    import pyarrow as pa

    for b in pa.ipc.open_stream(pa.py_buffer(pack)):
        yield from slices([b], 256)


def _distinct_in_blocks(blocks: DataFrame) -> DataFrame:
    """(block, segment, n): how often each segment comes in a block's texts."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            for block, pack in zip(b.column("block").to_pylist(), b.column("docs")):
                counts = Counter()
                for part in _documents(pack.as_py()):
                    for text in part.column("text").to_pylist():
                        if not _empty(text):
                            counts.update(segments(" " + text))
                columns = ([block] * len(counts), list(counts), list(counts.values()))
                kinds = (pa.int64(), pa.string(), pa.int64())
                yield from slices([pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["block", "segment", "n"])], 8192)

    return blocks.mapInArrow(run, "block long, segment string, n long")


def _aligned(distinct: DataFrame, models) -> DataFrame:
    """(segment, n, n_a, n_b, n_groups, groups, a, b): each segment's alignment; a and b are the two sides of its links."""
    kinds = "segment string, n long, n_a long, n_b long, n_groups long, groups string, a array<int>, b array<int>"

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        by = _worker(models.value)
        for part in slices(batches):
            found = list(by.align(part.column("segment").to_pylist()))
            ends = pa.array(np.cumsum([0, *[len(x.a) for x in found]]), pa.int32())
            lists = [pa.ListArray.from_arrays(ends, np.concatenate([getattr(x, side) for x in found] or [np.zeros(0, np.int32)])) for side in "ab"]
            numbers = [pa.array([getattr(x, c) for x in found], pa.int64()) for c in ("n_a", "n_b", "n_groups")]
            yield pa.RecordBatch.from_arrays([part.column("segment"), part.column("n"), *numbers, pa.array([x.groups for x in found], pa.string()), *lists], [x.split(" ")[0] for x in kinds.split(", ")])

    return distinct.mapInArrow(run, kinds)


def _links(aligned: DataFrame, *columns: str) -> DataFrame:
    return aligned.select(*columns, F.explode(F.arrays_zip("a", "b")).alias("link")).select(*columns, "link.a", "link.b")


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(a, b, links, best): how many links of the whole corpus hold each pair of ids, and whether that is the most of its b."""
    pairs = _links(aligned, "n").groupBy("a", "b").agg(F.sum("n").alias("links"))
    most = pairs.groupBy("b").agg(F.max("links").alias("most"))
    return pairs.join(most, "b").select("a", "b", "links", (F.col("links") == F.col("most")).alias("best"))


def _packs(known: DataFrame) -> DataFrame:
    """(asker, n, pack binary) of known(asker, segment, groups, <facts>): what a task has for a block as columns, compressed
    together, at a fraction of the bytes that its rows take in a shuffle. A task holds about PACK_BYTES of rows."""

    def pack(held: list):
        import numpy as np
        import pyarrow as pa
        from zstandard import ZstdCompressor

        t = pa.Table.from_batches(held).sort_by("asker").combine_chunks()
        asker = t.column("asker").to_numpy()
        starts = np.nonzero(np.r_[True, asker[1:] != asker[:-1]])[0].tolist()
        facts, texts = np.stack([t.column(c).to_numpy() for c in FACTS]), []
        for c in ("segment", "groups"):
            x = t.column(c).combine_chunks()
            x = x.chunk(0) if isinstance(x, pa.ChunkedArray) else x
            texts.append((np.frombuffer(x.buffers()[1], np.int32)[x.offset : x.offset + len(x) + 1], memoryview(x.buffers()[2])))
        packer, out = ZstdCompressor(level=3), []
        for lo, hi in zip(starts, [*starts[1:], len(asker)]):
            columns = [facts[:, lo:hi].astype("<i8").tobytes()]
            for ends, data in texts:
                columns += [(ends[lo : hi + 1] - ends[lo]).astype("<i4").tobytes(), bytes(data[ends[lo] : ends[hi]])]
            out.append(packer.compress(b"".join(columns)))
        sizes = np.diff([*starts, len(asker)])
        return pa.RecordBatch.from_arrays([pa.array(asker[starts]), pa.array(sizes, pa.int64()), pa.array(out, pa.binary())], ["asker", "n", "pack"])

    def run(batches: Iterator) -> Iterator:
        _worker.cache_clear()  # the tokenizers are not needed any more
        held, size = [], 0
        for b in batches:
            held.append(b)
            size += b.nbytes
            if size > PACK_BYTES:
                yield pack(held)
                held, size = [], 0
        if size:
            yield pack(held)

    return known.mapInArrow(run, "asker long, n long, pack binary")


def _unpacked(packs) -> tuple[list[str], list[str], object]:
    """(segments, groups, facts with a row for each) of a table of packs."""
    import numpy as np
    import pyarrow as pa
    from zstandard import ZstdDecompressor

    opener, names, groups, facts = ZstdDecompressor(), [], [], [np.zeros((0, len(FACTS)), np.int64)]
    for n, pack in zip(packs.column("n").to_pylist(), packs.column("pack")):
        raw = memoryview(opener.decompress(pack.as_py()))
        at = 8 * n * len(FACTS)
        facts.append(np.frombuffer(raw[:at], "<i8").reshape(len(FACTS), n).T)
        for to in (names, groups):
            ends, at = raw[at : at + 4 * n + 4], at + 4 * n + 4
            size = int(np.frombuffer(ends, "<i4")[-1])
            to += pa.StringArray.from_buffers(n, pa.py_buffer(ends), pa.py_buffer(raw[at : at + size])).to_pylist()
            at += size
    return names, groups, np.concatenate(facts)


def _compose(blocks: DataFrame, packs: DataFrame) -> DataFrame:
    """Documents of a block, put together from the block's own segments."""

    def run(blocks, packs):
        import numpy as np
        import pyarrow as pa

        _worker.cache_clear()
        names, groups, facts = _unpacked(packs)
        place = dict(zip(names, range(len(names))))
        del names

        def pieces():
            for t in _documents(blocks.column("docs")[0].as_py()):
                sums, texts = [], []
                for text in t.column("text").to_pylist():
                    at = [] if _empty(text) else [place[s] for s in segments(" " + text)]
                    sums.append(facts[at].sum(0))
                    texts.append(";".join([groups[i] for i in at]))
                sums = np.array(sums, np.int64).reshape(-1, len(FACTS))
                yield pa.RecordBatch.from_arrays([t.column("doc_id"), *[pa.array(sums[:, i]) for i in range(len(FACTS))], pa.array(texts, pa.string())], ["doc_id", *FACTS, "groups"])

        return pa.Table.from_batches(pieces(), pa.schema([("doc_id", pa.int64()), *[(c, pa.int64()) for c in FACTS], ("groups", pa.string())]))

    kinds = f"doc_id long, {', '.join(f'{c} long' for c in FACTS)}, groups string"
    return blocks.groupBy("block").cogroup(packs.groupBy("asker")).applyInArrow(run, kinds)


def align_documents(spark: SparkSession, docs: DataFrame, model_a: str | None = None, model_b: bytes | None = None, block_bytes: int = 16 << 20) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups) for every row of docs(doc_id, text, ...).

    A is a byte-level tokenizer (the text of its .json file), B a SentencePiece one (its file's bytes); A reads
    a space and the text, B the text, before which it puts a space. groups has the ids of both between the
    offsets where both end a token. A link is a pair of tokens whose bytes overlap; n_best counts those whose
    pair of ids is the most frequent of its B id in the whole corpus, count_sum adds the pairs' counts.
    Null and empty texts, and such as a tokenizer doesn't give back (those with U+2581), have zeros and no groups.

    Texts are cut before white space where A's pattern always cuts and where no entry of B reaches across
    (`refuse_other_pieces` proves it from the file and raises otherwise), so segments have the tokens they
    have within the text. Rows lie in blocks of about block_bytes of text; a block asks for each of its
    segments once, each distinct segment is tokenised once, and its alignment is joined back to the blocks
    that asked, where documents are composed. Counts of pairs weigh each distinct segment by how often it
    comes. A segment that all texts have is asked once a block. Very long texts are read whole: one is a
    block of its own. Repeated rows and null doc_ids come back as given and count as often as they come;
    further columns are not read; an empty table gives an empty one.
    """
    model_a, model_b = model_a or tokenizer_file(), model_b or piece_file()
    refuse_other_splits(model_a)
    if len(set(json.loads(model_a)["model"]["vocab"]) & set(byte_letters())) != 256:
        raise ValueError("this tokenizer lacks bytes")
    refuse_other_pieces(model_b)
    scratch = Scratch(spark, "alignment")
    models = spark.sparkContext.broadcast((model_a, model_b))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    blocks = scratch.save(_in_blocks(texts, block_bytes), "blocks", "uncompressed")
    asked = scratch.save(_distinct_in_blocks(blocks), "asked", "zstd")
    distinct = asked.groupBy("segment").agg(F.sum("n").alias("n"))
    aligned = scratch.save(_aligned(distinct, models).withColumn("number", F.monotonically_increasing_id()), "aligned", "zstd")
    scratch.release()
    pairs = scratch.save(pair_counts(aligned), "pairs")
    small = F.broadcast(pairs) if pairs.count() <= MOST_PAIRS else pairs
    scored = _links(aligned, "number").join(small, ["a", "b"]).groupBy("number").agg(F.count("*").alias("n_links"), F.count_if("best").alias("n_best"), F.sum("links").alias("count_sum"))
    facts = scratch.save(aligned.drop("a", "b", "n").join(scored, "number").select("segment", *FACTS, "groups"), "facts", "zstd")
    scratch.drop("aligned")
    scratch.release()
    known = scratch.save(_packs(asked.select(F.col("block").alias("asker"), "segment").join(facts, "segment")), "known", "uncompressed")
    for name in ("asked", "facts", "pairs"):
        scratch.drop(name)
    scratch.release()
    return _compose(blocks, known)
