"""Best-fit packing by minimum bin slack over the histogram of piece lengths.

A bin is filled with the fullest feasible combination of the lengths still available, found by subset-sum dynamic
programming over one bitset (a Python integer whose bit i says that i tokens can be reached). The search sees only
how many pieces have each length, at most ``CAPACITY`` numbers whatever the corpus holds, and the combination it
finds is taken as often as its lengths last; each step uses up a length, so the plan has few rows. Pieces then get
a rank among those of their length and look up their bin and offset in the broadcast plan.

The rank is counted in two steps, within (length, slice) and over the slices before, so that a length that a third
of all pieces share is spread over many tasks; equal rows go to different slices, whose number grows with the pieces.

Edge cases: a null or empty text is the end token alone, one piece of length 1; a longer document is cut into
pieces of ``CAPACITY`` tokens, the last may be shorter; rows that share a ``doc_id``, or have none, are packed one
by one; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from corvane.llm import common as C

CAPACITY, END = 2048, 0
TOKENIZER = "word_bpe_49k.json"
#: Slices by which pieces of one length are ranked side by side at least, and the pieces for each beyond that.
SLICES, RANKED = 256, 1 << 22


# The rules of a tokenizer file that ``WordIds`` can follow word by word.
NORMALIZERS = ("NFC", "Replace", "Lowercase")
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: The Latin letters that NFC leaves alone, on which all versions of Unicode agree.
LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
_LETTER = re.compile(f"[{LETTERS}]+")
#: ``SPLIT`` over those letters, and the texts that it splits as the tokenizer does: their lower case has no other letters.
WORDS = re.compile(SPLIT.replace(r"\p{L}", LETTERS).replace(r"\p{N}", "0-9"))
PLAIN = re.compile("[\t-\r\x20-\x7e\u00d7\u00f7" + "".join(c for c in map(chr, range(0xC0, 0x250)) if _LETTER.fullmatch(c) and _LETTER.fullmatch(c.lower())) + "]*")
BLANKS = re.compile("[\t-\r ]+")
ENDS = "</w>"


def word_by_word(rules: dict) -> bool:
    """Whether a tokenizer's file has the rules that ``WordIds`` follows."""
    steps = (rules.get("normalizer") or {}).get("normalizers") or []
    split, *rest = (rules.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
    return (
        tuple(s["type"] for s in steps) == NORMALIZERS and (steps[1]["pattern"], steps[1]["content"]) == ({"Regex": r"\s+"}, " ")
        and split.get("pattern") == {"Regex": SPLIT} and split.get("behavior") == "Removed" and split.get("invert") is True
        and [(s["type"], s.get("add_prefix_space"), s.get("use_regex")) for s in rest] == [("ByteLevel", False, False)]
        and rules["model"].get("end_of_word_suffix") == ENDS and not rules["model"].get("dropout") and all("<|" in t["content"] for t in rules["added_tokens"])
    )


class WordIds(dict):
    """A lower-cased word to the little-endian bytes of its ids.

    Exact for a tokenizer that drops white space, lowers case, and encodes each word by itself, which its file says:
    new words are encoded many at a time and told apart by their end-of-word ids. Chunks of unusual characters, kept
    under a key that starts with a blank, go to the tokenizer as they are, and so does every text of a tokenizer with
    other rules. The table is bounded; it forgets all when full.
    """

    limit, block = 400_000, 2_000

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.by_word = word_by_word(json.loads(self.tokenizer.to_str()))
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[i for token, i in vocabulary.items() if token.endswith(ENDS)]] = True

    def direct(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def split(self, text: str) -> list[str]:
        """The keys of a text, in order."""
        if not self.by_word or "<|" in text:  # may hold special tokens, which are matched before case is lowered
            return [" " + text]
        if PLAIN.fullmatch(text):
            return WORDS.findall(text.lower())
        out: list[str] = []
        for chunk in BLANKS.split(text):
            if PLAIN.fullmatch(chunk):
                out += WORDS.findall(chunk.lower())
            else:
                out.append(" " + chunk)
        return out

    def learn(self, keys: set[str]) -> None:
        """Make sure that all of ``keys`` are known."""
        new = keys - self.keys()
        if len(self) + len(new) > self.limit:
            self.clear()
            new = keys
        self.update((k, self.direct(k[1:])) for k in new if k[0] == " ")
        unknown = [k for k in new if k[0] != " "]
        for i in range(0, len(unknown), self.block):
            some = unknown[i : i + self.block]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, np.uint32)
            ends = (np.flatnonzero(self.last[ids]) + 1) * 4
            if len(ends) != len(some):
                self.update((w, self.direct(w)) for w in some)
                continue
            data = ids.tobytes()
            self.update(zip(some, map(data.__getitem__, map(slice, [0, *ends[:-1].tolist()], ends.tolist())), strict=True))


_KNOWN: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    if path not in _KNOWN:
        _KNOWN[path] = WordIds(path)
    return _KNOWN[path]


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def cut_batches(path: str, capacity: int):
    """``doc_id, text`` to one row per piece: where it starts, how long it is, the CRC of its ids, and its number among equal ones of the batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = word_ids(path)
        end = array("I", [END]).tobytes()
        for batch in batches:
            out: list[list[int | None]] = [[], [], [], [], [], []]
            equal: Counter[tuple] = Counter()
            keys = [known.split(text or "") for text in batch.column("text").to_pylist()]
            known.learn(set().union(*keys))
            for key, own in zip(batch.column("doc_id").to_pylist(), keys, strict=True):
                ids = b"".join(map(known.__getitem__, own)) + end
                total = len(ids) // 4
                for piece, start in enumerate(range(0, total, capacity)):
                    part = ids[4 * start : 4 * (start + capacity)]
                    crc = zlib.crc32(part)
                    for column, value in zip(out, (key, piece, start, len(part) // 4, crc, equal[key, piece, crc]), strict=True):
                        column.append(value)
                    equal[key, piece, crc] += 1
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), *(pa.array(x, pa.int64()) for x in out[2:])], ["doc_id", "piece", "start", "length", "ids_crc32", "nth"])

    return run


def fullest(counts: dict[int, int], capacity: int) -> list[tuple[int, int]]:
    """The combination (length, how many) with the largest sum up to ``capacity``; longer lengths first on ties."""
    mask = (1 << (capacity + 1)) - 1
    reach = 1
    steps: list[tuple[int, int, int]] = []
    for length in sorted(counts, reverse=True):
        left, part = min(counts[length], capacity // length), 1
        while left:
            take = min(part, left)
            steps.append((length, take, reach))
            reach |= (reach << (length * take)) & mask
            left -= take
            part *= 2
        if reach >> capacity:
            break
    at = reach.bit_length() - 1
    chosen: dict[int, int] = {}
    for length, take, before in reversed(steps):
        if not before >> at & 1:
            chosen[length] = chosen.get(length, 0) + take
            at -= length * take
    return sorted(chosen.items(), reverse=True)


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (length, first rank, ranks, first bin, pieces of that length in each bin, offset of the first)."""
    left = {length: n for length, n in histogram.items() if n}
    used = dict.fromkeys(left, 0)
    rows, bins = [], 0
    while left:
        chosen = fullest(left, capacity)
        times = min(left[length] // n for length, n in chosen)
        offset = 0
        for length, n in chosen:
            rows.append((length, used[length], n * times, bins, n, offset))
            used[length] += n * times
            offset += n * length
            left[length] -= n * times
            if not left[length]:
                del left[length]
        bins += times
    return rows


def pack(documents: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset``, one row per piece."""
    spark = documents.sparkSession
    C.small_batches(spark)
    path = tokenizer or tokenizer_path()
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    pieces = C.settle(texts.mapInArrow(C.tidy(cut_batches(path, capacity)), "doc_id long, piece int, start long, length long, ids_crc32 long, nth long"), "pieces")
    slices = max(SLICES, pieces.count() // RANKED)
    slice_of = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", "nth"), F.lit(slices)).cast("int")
    sliced = pieces.withColumn("slice", slice_of)
    # one row for each length and slice; the histogram has one for each length
    sizes = sliced.groupBy("length", "slice").agg(F.count("*").alias("n"))
    before = sizes.select("length", "slice", (F.sum("n").over(Window.partitionBy("length").orderBy("slice")) - F.col("n")).alias("before"))
    histogram = {r.length: r.n for r in sizes.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    schema = "length long, first long, ranks long, bin long, each long, at long"
    rows = spark.createDataFrame(plan(histogram, capacity), schema)
    ranked = sliced.withColumn("r", F.row_number().over(Window.partitionBy("length", "slice").orderBy("doc_id", "piece", "start", "ids_crc32", "nth")) - 1)
    ranked = ranked.join(before, ["length", "slice"]).withColumn("rank", F.col("r") + F.col("before"))
    steps = rows.groupBy("length").agg(F.sort_array(F.collect_list(F.struct("first", "ranks", "bin", "each", "at"))).alias("steps"))
    placed = ranked.join(F.broadcast(steps), "length").withColumn("s", _last_at_most("steps", "rank"))
    nth = F.col("rank") - F.col("s.first")
    return placed.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("s.bin") + F.floor(nth / F.col("s.each"))).cast("long").alias("sequence_id"),
        (F.col("s.at") + (nth % F.col("s.each")) * F.col("length")).cast("long").alias("offset"),
    )


def _last_at_most(steps: str, rank: str):
    """The last element of a sorted array of steps whose first rank is not beyond ``rank``, by halving."""
    low = F.aggregate(
        F.sequence(F.lit(0), F.lit(20)),
        F.struct(F.lit(0).alias("lo"), (F.size(steps) - 1).alias("hi")),
        lambda s, _: F.struct(
            F.when(F.get(F.col(steps), _middle(s))["first"] <= F.col(rank), _middle(s)).otherwise(s["lo"]).alias("lo"),
            F.when(F.get(F.col(steps), _middle(s))["first"] <= F.col(rank), s["hi"]).otherwise(_middle(s) - 1).alias("hi"),
        ),
        lambda s: s["lo"],
    )
    return F.get(F.col(steps), low)


def _middle(s):
    return F.shiftright(s["lo"] + s["hi"] + 1, 1)
