"""Cross-tokenizer alignment with exact-text deduplication.

Two tokenizers cut the same text into tokens; a *link* is a token of the one and a
token of the other whose byte ranges overlap. Both cuts together split the text into
elementary ranges, and each range is one link: an overlap of two ranges is one range.
Offsets where tokens of both end cut the tokens into *groups*.

The corpus is shuffled by full text, so each distinct text is tokenised and aligned
once, however many documents hold it; its links are kept as (pair, times), a pair
being the two ids in one number. Counts of pairs over the corpus weigh a text by the
number of its copies. Measures of a text come back to its documents by the SHA-256 of
the text: the join carries no texts, and the grouping itself is by the text.

How it spreads: equal texts are counted map-side before the shuffle; tokenising takes
texts in groups of about ``GROUP_BYTES``; a longer text is cut for the tokenizers before
single spaces between other characters, where neither vocabulary has a token that
crosses (checked when the vocabulary is read; else the text stays whole). The counts of
pairs are broadcast only if they number up to ``broadcast_pairs``; beyond that they
meet the links in a shuffle join, with the same result.

Tokenizer A's merges run in the faster of two engines over one vocabulary (the byte
strings and ids of its file): the one of ``tiktoken`` for texts of characters whose Unicode
class was settled long ago, since the two split texts into words by class; else the
file's own. Both give the same ids (tested). Tokenizer A is byte-level and gets a space before the text; tokenizer B adds its own.
Special tokens are never produced: their strings inside texts are plain text.

Defined results: texts that are null, empty, or whose joined tokens differ from space +
text have no tokens (zeros, empty group string); each row is a document, also repeated
ones and those without a doc_id, and weighs 1 in the counts; an empty table gives an
empty result; extra columns are ignored. Vocabularies are read by the driver and sent to the
tasks (files of fixed size); they are never written.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from agentlake.llm.common import arrow_batches, groups_of_bytes, stored

#: Bytes of texts aligned at once; a text longer than that is cut for the tokenizers.
GROUP_BYTES, SLICE = 1 << 19, 1 << 18
TEXTS = 256
#: Pairs whose counts are broadcast (16 bytes each); more are joined by a shuffle.
BROADCAST_PAIRS = 1 << 21


#: The words of byte-level vocabularies, as a pattern, and characters that every Unicode table puts in the same class:
#: Latin, Greek, Cyrillic, punctuation, kana, the first block of Han, Hangul.
WORDS = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_SETTLED = re.compile("[\\x00-\u0377\u0384-\u0389\u038e-\u03a1\u03a3-\u0523\u2000-\u2064\u3001-\u3029\u3041-\u3094\u30a1-\u30fe\u4e00-\u9fa5\uac00-\ud7a3]*")


def byte_alphabet() -> dict[str, int]:
    """Character -> byte of byte-level vocabularies: printable characters of Latin-1
    stand for themselves, the other bytes, in order, for U+0100 and on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


def slices(text: str, limit: int) -> list[str]:
    """The text cut before single spaces between other characters, into parts of
    about ``limit`` characters where there are such places."""
    out, start, at = [], 0, limit
    while at < len(text) - 1:
        at = text.find(" ", at)
        if at < 0 or at >= len(text) - 1:
            break
        if not text[at - 1].isspace() and not text[at + 1].isspace():
            out.append(text[start:at])
            start, at = at, at + limit
        else:
            at += 1
    return [*out, text[start:]]


def _joined(table: list[bytes], ids: np.ndarray) -> bytes:
    return b"".join(map(table.__getitem__, ids.tolist()))


class Aligner:
    """Both tokenizers, in a task."""

    def __init__(self, a_json: str, b_model: bytes):
        import os
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        import tiktoken
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer
        self.a = Tokenizer.from_str(a_json)
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_proto=b_model)
        letters = byte_alphabet()
        self.bytes_a = [bytes(letters[c] for c in self.a.id_to_token(i) or "") for i in range(self.a.get_vocab_size())]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        # merges ranked by the id of their result; special tokens are no result of a merge
        special = {t.content for t in self.a.get_added_tokens_decoder().values() if t.special}
        ranks = {self.bytes_a[i]: i for t, i in self.a.get_vocab(with_added_tokens=False).items() if t not in special}
        self.fast = tiktoken.Encoding("a", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={})
        self.crosses = any("▁" in p.lstrip("▁") for p in pieces)
        self.len_a, self.len_b = (np.array([len(t) for t in x]) for x in (self.bytes_a, self.bytes_b))
        # how an id is written in the group string: followed by another of its side, or last in its group
        a, b = len(self.bytes_a), len(self.bytes_b)
        self.written = [f"{i}{end}" for n, ends in ((a, ",|"), (b, ",;")) for end in ends for i in range(n)]

    def ids_a(self, texts: list[str]) -> list[np.ndarray]:
        """A's ids of texts that begin with the space before them."""
        out = [self.fast.encode_to_numpy(t, disallowed_special=()) if _SETTLED.fullmatch(t) else None for t in texts]
        rest = [i for i, x in enumerate(out) if x is None]
        for i, e in zip(rest, self.a.encode_batch_fast([texts[i] for i in rest], add_special_tokens=False)):
            out[i] = np.array(e.ids, np.uint32)
        return out

    def ids(self, texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids of both tokenizers for each text (not empty)."""
        parts = [[t] if self.crosses or len(t) <= SLICE else slices(t, SLICE) for t in texts]
        flat = [p for ps in parts for p in ps]
        firsts = np.cumsum([0, *map(len, parts)])[:-1]
        begins = set(firsts.tolist())
        # a part after the first begins with the space that both put before a text
        a = self.ids_a([" " + p if i in begins else p for i, p in enumerate(flat)])
        b = [np.array(x, np.int32) for x in self.b.encode([p if i in begins else p[1:] for i, p in enumerate(flat)], num_threads=1)]

        def join(lists: list[np.ndarray]) -> list[np.ndarray]:
            return [np.concatenate(lists[f:f + len(ps)]) if len(ps) > 1 else lists[f] for f, ps in zip(firsts, parts)]
        return join(a), join(b)

    def align(self, texts: list[str]) -> list[tuple | None]:
        """For each text (n_a, n_b, n_groups, n_links, groups' SHA-256, pairs, times),
        or None if its tokens do not make up space + text."""
        ids_a, ids_b = self.ids(texts)
        whole = [b" " + t.encode() for t in texts]
        good = [i for i, w in enumerate(whole) if _joined(self.bytes_a, ids_a[i]) == w and _joined(self.bytes_b, ids_b[i]) == w]
        out: list[tuple | None] = [None] * len(texts)
        if not good:
            return out
        a = np.concatenate([ids_a[i] for i in good]).astype(np.int64)
        b = np.concatenate([ids_b[i] for i in good]).astype(np.int64)
        n_a, n_b = np.array([len(ids_a[i]) for i in good]), np.array([len(ids_b[i]) for i in good])
        ends_a, ends_b = np.cumsum(self.len_a[a]), np.cumsum(self.len_b[b])
        stops = np.cumsum([len(whole[i]) for i in good])  # the texts stand one behind the other
        every = np.concatenate([ends_a, ends_b])
        every.sort(kind="stable")  # two runs in order: merged
        twice = every[1:] == every[:-1]
        both, every = every[1:][twice], every[np.concatenate([[True], ~twice])]
        codes = a[np.searchsorted(ends_a, every)] * len(self.bytes_b) + b[np.searchsorted(ends_b, every)]
        text_of = np.searchsorted(stops, every)
        n_links, n_groups = np.bincount(text_of), np.bincount(np.searchsorted(stops, both))
        space = len(self.bytes_a) * len(self.bytes_b)
        keys, times = np.unique(text_of * space + codes, return_counts=True)
        cuts = np.searchsorted(keys, np.arange(len(good) + 1) * space)
        # tokens in the order of the group string: group by group, A before B
        in_a, in_b = np.searchsorted(both, ends_a), np.searchsorted(both, ends_b)
        last_a, last_b = both[in_a] == ends_a, both[in_b] == ends_b
        upto_a, upto_b = np.cumsum(np.bincount(in_a)), np.cumsum(np.bincount(in_b))
        order = np.empty(len(a) + len(b), np.int64)
        order[np.arange(len(a)) + upto_b[in_a] - np.bincount(in_b)[in_a]] = a + last_a * len(self.bytes_a)
        order[np.arange(len(b)) + upto_a[in_b]] = 2 * len(self.bytes_a) + b + last_b * len(self.bytes_b)
        tokens = np.cumsum(n_a + n_b)
        for k, i in enumerate(good):
            line = "".join(map(self.written.__getitem__, order[tokens[k] - n_a[k] - n_b[k]:tokens[k]].tolist()))[:-1]
            part = slice(cuts[k], cuts[k + 1])
            out[i] = (int(n_a[k]), int(n_b[k]), int(n_groups[k]), int(n_links[k]), hashlib.sha256(line.encode()).hexdigest(), keys[part] - k * space, times[part])
        return out


def aligned(docs: DataFrame, a_path: str, b_path: str) -> tuple[DataFrame, int]:
    """Each distinct text that has tokens: key (SHA-256 of the text), copies, its
    measures, pairs and times; and the size of B's vocabulary (pair = A id * size + B id)."""
    spark = docs.sparkSession
    with open(a_path, encoding="utf-8") as f:
        a_json = f.read()
    with open(b_path, "rb") as f:
        b_model = f.read()
    from sentencepiece import SentencePieceProcessor
    size_b = SentencePieceProcessor(model_proto=b_model).get_piece_size()
    size_a = 1 + max(max(json.loads(a_json)["model"]["vocab"].values()), *(t["id"] for t in json.loads(a_json)["added_tokens"]), 0)
    files = spark.sparkContext.broadcast((a_json, b_model))
    texts = docs.where("text IS NOT NULL AND text <> ''").groupBy("text").agg(F.count("*").alias("copies"))
    names = ("n_a", "n_b", "n_groups", "n_links")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        aligner = Aligner(*files.value)
        for pdf in frames:
            raw = pdf["text"].tolist()
            for start, group in groups_of_bytes(raw, GROUP_BYTES):
                done = [(start + i, x) for i, x in enumerate(aligner.align(group)) if x is not None]
                if done:
                    at, found = [i for i, _ in done], list(zip(*(x for _, x in done)))
                    yield pd.DataFrame({"key": pdf["key"].iloc[at].tolist(), "copies": pdf["copies"].iloc[at].to_numpy(), **dict(zip(names, found)),
                                        "groups_sha256": found[4], "pairs": list(found[5]), "times": list(found[6])})

    pair = "int" if size_a * size_b < 1 << 31 else "long"
    schema = f"key string, copies long, {', '.join(f'{n} long' for n in names)}, groups_sha256 string, pairs array<{pair}>, times array<int>"
    with arrow_batches(spark, TEXTS):
        return stored(texts.select(F.sha2("text", 256).alias("key"), "text", "copies").mapInPandas(run, schema), "aligned"), size_b


def pair_counts(texts: DataFrame, size_b: int) -> DataFrame:
    """pair, total (links of the corpus that hold it), best (no pair of its B id has more)."""
    each = texts.select("copies", F.explode(F.arrays_zip("pairs", "times")).alias("x"))
    counts = each.groupBy(F.col("x.pairs").alias("pair")).agg(F.sum(F.col("copies") * F.col("x.times")).alias("total"))
    # the pairs of a B id are as many as A has ids at most
    return counts.withColumn("best", F.col("total") == F.max("total").over(Window.partitionBy(F.col("pair") % size_b)))


def measure(docs: DataFrame, a_path: str, b_path: str, broadcast_pairs: int = BROADCAST_PAIRS) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every row."""
    texts, size_b = aligned(docs, a_path, b_path)
    counts = stored(pair_counts(texts, size_b), "pair-counts")
    if counts.count() <= broadcast_pairs:
        counts = F.broadcast(counts)
    each = texts.select("key", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("key", F.col("x.pairs").alias("pair"), F.col("x.times").alias("n"))
    sums = each.join(counts, "pair").groupBy("key").agg(F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).alias("n_best"), F.sum(F.col("n") * F.col("total")).alias("count_sum"))
    found = texts.drop("pairs", "times", "copies").join(sums, "key")
    every = docs.select("doc_id", F.sha2("text", 256).alias("key")).join(found, "key", "left")
    numbers = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")
    return every.select("doc_id", *[F.coalesce(n, F.lit(0)).cast("long").alias(n) for n in numbers], F.coalesce("groups_sha256", F.lit("")).alias("groups_sha256"))
