"""Token counts of texts, from one count for each distinct pre-token.

A SentencePiece BPE model whose pieces hold the space mark at their start only
never merges over the border before a space, so a text's pieces are those of
its pre-tokens: a run of spaces with what follows it up to the next space.

Blocks of documents become two things, written once: the block's distinct
pre-tokens, and for each document its frequencies, as (number of the
pre-token in the block, times).  Pre-tokens go to shards by hash; a shard holds
each of them once however many blocks asked, counts its pieces, and sends each
block its answers.  Joined to the frequencies by number they give

    tokens of a document = sum of times x pieces.

A text's ids are never made; the model sees distinct pre-tokens alone.  A
pre-token as common as "the" costs one entry for each block, texts are read
once and not shuffled, and there are as many shards as the blocks need.

The same cut serves the ``tokenizers`` files only if their pre-tokenizer agrees,
so this module takes SentencePiece models and checks the property on loading.

Defined cases: a null text is empty and has no tokens; special strings in a
text are ordinary text, as the library's default has it; rows that are equal
in id or text are counted one by one.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kolumna.llm import textblocks
from kolumna.llm.work import modest, saved

#: Bytes of text in a block, and bytes of blocks' distinct pre-tokens that a shard is meant for.
BLOCK, SHARD = 4 << 20, 8 << 20
#: Pre-tokens whose pieces are held at once.
CHUNK = 4096

#: A run of spaces (or their mark) and what follows up to the next, or what a text begins with.
_PIECES = re.compile(r"[ ▁]+[^ ▁]*|[^ ▁]+")
_U = np.uint64


class Counter:
    """Counts pieces of pre-tokens with a SentencePiece model."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        if any("▁" in p.lstrip("▁") for p in pieces) or self.model.encode("a  b", out_type=str) != ["▁a", "▁", "▁b"] or not self.model.encode("  "):
            raise ValueError(f"{path}: pieces of this model cross spaces, or it drops them; its pre-tokens can't be counted apart")

    def of(self, tokens: list[str]) -> np.ndarray:
        """Pieces of each pre-token; "▁" stands for a space alone."""
        counts = [n for a in range(0, len(tokens), CHUNK) for n in map(len, self.model.encode(tokens[a : a + CHUNK], num_threads=1))]
        return np.array([1 if t == "▁" else n for t, n in zip(tokens, counts)], np.int64)


def _odd(text: str) -> list[str]:
    """Pre-tokens of a text with other than single spaces inside, less the space that the model puts before each."""
    parts = _PIECES.findall(text)
    # Before spaces at a text's start comes the model's own.
    return parts[:1] + [p[1:] or "▁" for p in parts[1:]]


def pre_tokens(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All pre-tokens of some texts, and the text of each."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    odd = pc.match_substring_regex(texts, "  |▁|^ | $").to_numpy(zero_copy_only=False)
    plain = pc.if_else(pa.array(odd), "", texts)
    lists = pc.split_pattern(plain, " ")
    tokens = pc.list_flatten(lists)
    owner = np.repeat(np.arange(len(texts)), pc.list_value_length(lists).to_numpy())
    extra = [_odd(t.as_py()) for t in texts.filter(pa.array(odd))]
    if extra:
        tokens = pa.concat_arrays([tokens, pa.array([p for e in extra for p in e], tokens.type)])
        owner = np.concatenate([owner, np.repeat(np.flatnonzero(odd), [len(e) for e in extra])])
    return tokens, owner


def frequencies(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct pre-tokens of some texts; and of each (text, pre-token) that occurs the text, the pre-token's number and how often, by text."""
    tokens, owner = pre_tokens(texts)
    coded = tokens.dictionary_encode()
    names = max(1, len(coded.dictionary))
    key = owner * names + coded.indices.to_numpy()
    key.sort()
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else key
    times = np.diff(np.append(first, len(key)))
    key = key[first]
    return coded.dictionary, key // names, key % names, times


def count_batch(counter: Counter, texts: pa.Array) -> np.ndarray:
    """Tokens of each text."""
    names, text, number, times = frequencies(texts)
    return np.bincount(text, counter.of(names.to_pylist())[number] * times, minlength=len(texts)).astype(np.int64)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents to blocks: ids, sizes, packed frequencies, and the distinct pre-tokens in the order of their hashes."""
    start, number = TaskContext.get().partitionId() << 32, 0
    for batch in batches:
        texts = textblocks.column(batch, "text")
        _, offsets = textblocks.raw(texts)
        for i, j in textblocks.blocks(offsets, BLOCK):
            n = j - i
            names, text, token, times = frequencies(texts.slice(i, n))
            buf, starts = textblocks.raw(names)
            by = np.argsort(textblocks.hashes(buf, starts), kind="stable")
            rank = np.empty(len(by), np.int64)
            rank[by] = np.arange(len(by))
            data, starts = textblocks.raw(names.take(pa.array(by)))
            tokens = data[starts[0] : starts[-1]].tobytes()
            # A text's pre-tokens in order, each by how many places it is past the one before.
            order = np.lexsort((rank[token], text))
            place, text = rank[token][order], text[order]
            step = np.diff(place, prepend=-1) - 1
            first = np.flatnonzero(np.diff(text, prepend=-1))
            step[first] = place[first]
            lists = [pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), textblocks.column(batch, c).slice(i, n)) for c in ("doc_id", "n_bytes")]
            held = [*map(textblocks.squeezed, (np.bincount(text, minlength=n), step, times[order] - 1, np.diff(starts))), pa.compress(tokens, "zstd", asbytes=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([start + number]), *lists, *(pa.array([x], pa.binary()) for x in held), pa.array([len(tokens)], pa.int64())],
                ["block", "doc_id", "n_bytes", "distinct", "step", "times", "lengths", "tokens", "size"],
            )
            number += 1


def _asked(shards: int):
    """Blocks to the pre-tokens that they ask of each shard, which has a range of the hashes."""
    starts = np.array([-(-(k << 64) // shards) for k in range(shards)], _U)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, lengths, tokens, n in zip(*(textblocks.column(batch, c).to_pylist() for c in ("block", "lengths", "tokens", "size"))):
                size, tokens = textblocks.unsqueezed(lengths), pa.decompress(tokens, n, "zstd", asbytes=True)
                ends = np.concatenate([[0], np.cumsum(size)])
                cut = np.searchsorted(textblocks.hashes(np.frombuffer(tokens, np.uint8), ends), starts).tolist()
                parts = [(k, a, b) for k, (a, b) in enumerate(zip(cut, [*cut[1:], len(size)])) if b > a]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k for k, _, _ in parts], pa.int64()), pa.array([block] * len(parts), pa.int64()), pa.array([textblocks.squeezed(size[a:b]) for _, a, b in parts], pa.binary()), pa.array([pa.compress(tokens[ends[a] : ends[b]], "zstd", asbytes=True) for _, a, b in parts], pa.binary())],
                    ["shard", "block", "lengths", "tokens"],
                )

    return run


def _answered(path: str):
    """What blocks ask of a shard to the pieces of each of their pre-tokens: every distinct one is counted once."""

    def run(asked: pa.Table) -> pa.Table:
        lengths = [textblocks.unsqueezed(x) for x in textblocks.column(asked, "lengths").to_pylist()]
        ends = np.concatenate([[0], np.cumsum(np.concatenate(lengths))])
        held = b"".join(pa.decompress(x, int(n.sum()), "zstd", asbytes=True) for x, n in zip(textblocks.column(asked, "tokens").to_pylist(), lengths))
        tokens = pa.LargeStringArray.from_buffers(len(ends) - 1, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(held))
        coded = tokens.dictionary_encode()
        pieces = Counter(path).of(coded.dictionary.to_pylist())[coded.indices.to_numpy()]
        cut = np.concatenate([[0], np.cumsum([len(x) for x in lengths])])
        return pa.Table.from_arrays([textblocks.column(asked, "block"), textblocks.column(asked, "shard"), pa.array([textblocks.squeezed(pieces[a:b]) for a, b in zip(cut, cut[1:])], pa.binary())], names=["block", "shard", "pieces"])

    return run


def _summed(blocks: pa.Table, answers: pa.Table) -> pa.Table:
    """A block's frequencies and its answers to each document's tokens."""
    ids, sizes = (textblocks.column(blocks, c) for c in ("doc_id", "n_bytes"))
    by = np.argsort(textblocks.column(answers, "shard").to_numpy())
    held = textblocks.column(answers, "pieces").to_pylist()
    pieces = np.concatenate([np.zeros(0, np.int64), *(textblocks.unsqueezed(held[k]) for k in by)])
    distinct, step, times = (textblocks.unsqueezed(textblocks.column(blocks, c)[0].as_py()) for c in ("distinct", "step", "times"))
    place = np.cumsum(step + 1)
    place -= np.repeat(np.concatenate([[0], place])[np.cumsum(distinct) - distinct], distinct) + 1
    total = np.bincount(np.repeat(np.arange(len(distinct)), distinct), pieces[place] * (times + 1), minlength=len(distinct)).astype(np.int64)
    return pa.Table.from_arrays([ids.flatten(), sizes.flatten(), pa.array(total)], names=["doc_id", "n_bytes", "n_tokens"])


def token_counts(docs: DataFrame, model: str, doc_id: str = "doc_id", text: str = "text", limit: int = 4096) -> DataFrame:
    """One row for each document: doc_id, n_bytes, n_tokens, over_limit. ``model``: the model file's path, the same on all workers."""
    kind = docs.schema[doc_id].dataType.simpleString()
    whole = F.col(text).cast("string")
    rows = modest(docs).select(F.col(doc_id).alias("doc_id"), F.coalesce(F.octet_length(whole), F.lit(0)).cast("long").alias("n_bytes"), whole.alias("text"))
    packed = ("distinct", "step", "times", "lengths", "tokens")
    blocks = saved(rows.mapInArrow(_blocks, f"block bigint, doc_id array<{kind}>, n_bytes array<bigint>, {', '.join(f'{c} binary' for c in packed)}, size bigint"), "blocks")
    n, size = blocks.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()

    # Both sides are dealt to as many partitions as there are blocks or shards, so a task's share does not grow with the input.
    n, shards = max(1, n), max(1, math.ceil(size / SHARD))
    asked = blocks.select("block", "lengths", "tokens", "size").mapInArrow(_asked(shards), "shard bigint, block bigint, lengths binary, tokens binary")
    answers = asked.repartition(shards, "shard").groupBy("shard").applyInArrow(_answered(model), "block bigint, shard bigint, pieces binary")
    held = blocks.select("block", "doc_id", "n_bytes", "distinct", "step", "times").repartition(n, "block").groupBy("block")
    found = held.cogroup(answers.repartition(n, "block").groupBy("block")).applyInArrow(_summed, f"doc_id {kind}, n_bytes bigint, n_tokens bigint")
    return found.withColumn("over_limit", F.col("n_tokens") > limit)
