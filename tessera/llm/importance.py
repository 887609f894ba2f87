"""Importance resampling towards a target distribution, over a dictionary of distinct word n-grams.

Texts are read in blocks. A block counts its distinct runs of three words and sends them, packed, to the range of their
first two words, with the document of each place. A range so holds every run of two and three words that begins with its
pairs, and their counts over all blocks: there each distinct string is hashed once (a word once in each range that has pairs
of it, its hash being the state that those of its pairs go on from), and counts are summed in buckets. What a range
writes are the documents' features by bucket; when the gains of all buckets are known, they are joined to these and summed
for each document. Runs shorter than three words at a text's end have a missing word.

Blocks and ranges bound what a task holds; their number grows with the texts. A frequent word, pair or run is counted in
its block first, so a range gets it once from each block.
"""

from __future__ import annotations

import itertools
import pickle
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tessera.llm.common import batches_of, hash_words, mix64, only, settle

#: Words that a block of texts holds (a longer text is a block of its own), and characters of text for each range.
BLOCK_WORDS, RANGE_CHARS = 1_200_000, 14_000_000
#: Rows that go to Python at a time: packed features and texts are large.
ROWS = 1_000
BUCKETS = 10_000
#: A-Z in lower case; what is neither a digit, a letter nor beyond ASCII parts words.
_WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    """The words of a text, as UTF-8; a null text has none."""
    return text.encode("utf-8", "surrogatepass").translate(_WORD_BYTES).split() if text else []


def n_features(n_words):
    """Number of runs of one to three words in so many words."""
    return n_words + np.maximum(n_words - 1, 0) + np.maximum(n_words - 2, 0)


def pack(**arrays: np.ndarray | bytes) -> bytes:
    """Arrays of whole numbers in their narrowest type, the bytes of each place of a number compressed apart."""
    codec = pa.Codec("zstd", compression_level=3)
    out = {}
    for name, v in arrays.items():
        v = np.frombuffer(v, np.uint8) if isinstance(v, bytes) else v.astype(np.min_scalar_type(int(v.max()) if len(v) else 0))
        planes = v.view(np.uint8).reshape(len(v), v.itemsize).T
        out[name] = v.dtype.str, len(v), [codec.compress(np.ascontiguousarray(x), asbytes=True) for x in planes]
    return pickle.dumps(out, 5)


def unpack(packed: bytes) -> dict[str, np.ndarray]:
    codec, out = pa.Codec("zstd"), {}
    for name, (kind, n, planes) in pickle.loads(packed).items():
        raw = np.empty((n, len(planes)), np.uint8)
        for k, x in enumerate(planes):
            raw[:, k] = np.frombuffer(codec.decompress(x, n), np.uint8)
        out[name] = raw.reshape(-1).view(kind)
    return out


def common_heads(words: list[bytes]) -> np.ndarray:
    """How many bytes each of the sorted words has in common with the one before, 16 at most."""
    heads = np.array([b"", *words], "S16").view(np.uint8).reshape(-1, 16)
    return np.cumprod(heads[1:] == heads[:-1], axis=1, dtype=np.uint8).sum(axis=1, dtype=np.int64)


def sorted_words(heads: np.ndarray, tails: bytes) -> list[bytes]:
    """Words from what each has in common with the one before, and the rest of each."""
    out, word = [], b""
    for k, tail in zip(heads.tolist(), tails.split(b" "), strict=True):
        word = word[:k] + tail
        out.append(word)
    return out


def _runs(ids: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The second and third word (from 1; 0: none) of the run that begins at each place."""
    second, third = np.zeros_like(ids), np.zeros_like(ids)
    second[:-1] = ids[1:]
    ends = np.cumsum(lengths) - 1
    second[ends[lengths > 0]] = 0
    third[:-1] = second[1:]
    third[second == 0] = 0
    return second, third


def _distinct(first: np.ndarray, second: np.ndarray, third: np.ndarray, n: int) -> tuple[np.ndarray, ...]:
    """Distinct pairs and runs of ids up to n: both words of each pair, pair and third word of each run, and the run of each input."""
    pairs, of = _codes(first.astype(np.int64) * (n + 1) + second)
    runs, run_of = _codes(of.astype(np.int64) * (n + 1) + third)
    small = lambda x: x.astype(np.int32)
    return small(pairs // (n + 1)), small(pairs % (n + 1)), small(runs // (n + 1)), small(runs % (n + 1)), run_of


def _codes(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the number of each key among them; less memory than numpy's own."""
    order = np.argsort(keys).astype(np.int32)
    keys = keys[order]
    new = np.append(True, keys[1:] != keys[:-1])
    codes = np.empty(len(keys), np.int32)
    codes[order] = np.cumsum(new, dtype=np.int32) - 1
    return keys[new], codes


def _steps(values: np.ndarray, groups: np.ndarray) -> np.ndarray:
    """Values that grow within each group of neighbours as their steps, from 0 in each group."""
    return np.where(np.append(True, groups[1:] != groups[:-1]), values, np.diff(values, prepend=0))


def _summed(steps: np.ndarray, new_group: np.ndarray) -> np.ndarray:
    """The values of ``_steps``; ``new_group`` is not 0 where a group begins."""
    total = np.cumsum(steps, dtype=np.int64)
    begin = np.flatnonzero(new_group)
    return total - np.repeat((total - steps)[begin], np.diff(np.append(begin, len(steps))))


def _parts(flat: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The parts of ``flat`` between begins and ends, one after the other."""
    size = end - begin
    return flat[np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(size.sum())]


def _numbers() -> defaultdict[bytes, int]:
    """A dictionary that numbers its keys from 1 as they are asked for."""
    return defaultdict(itertools.count(1).__next__)


def _block(known: dict[bytes, int], texts: list[np.ndarray], n_ranges: int) -> Iterator[tuple[int, bytes]]:
    """Range and packed runs of a block of texts, given as ids (from 1) of the known words."""
    lengths = np.array([len(t) for t in texts], np.int64)
    first = np.concatenate(texts)
    if not len(first):
        return
    words = sorted(known)
    order = np.zeros(len(words) + 1, np.int32)  # ids in the order of the words
    order[[known[w] for w in words]] = np.arange(1, len(words) + 1)
    first = order[first]
    a, b, pair, third, run_of = _distinct(first, *_runs(first, lengths), len(words))
    heads = common_heads(words)
    flat = np.frombuffer(b" ".join([*words, b""]), np.uint8)
    word_ends = np.append(0, np.flatnonzero(flat == 32) + 1)
    hashes = np.concatenate([np.zeros(1, np.uint64), hash_words(words)])
    with np.errstate(over="ignore"):
        pair_range = (mix64(hashes[a] * np.uint64(0x9E3779B97F4A7C15) + hashes[b]) % np.uint64(n_ranges)).astype(np.int64)
    narrow = pair_range.astype(np.min_scalar_type(n_ranges))  # sorted by digits where two bytes hold it
    by_range = np.argsort(narrow[pair], kind="stable").astype(np.int32)  # runs of a range, in order of their pairs
    place = np.empty(len(by_range), np.int32)
    place[by_range] = np.arange(len(by_range))
    docs = np.repeat(np.arange(len(texts), dtype=np.int32), lengths)[np.argsort(place[run_of], kind="stable")]
    counts = np.bincount(run_of, minlength=len(pair))[by_range]
    docs_end, run_range = np.cumsum(counts), pair_range[pair[by_range]]
    ends = np.flatnonzero(np.append(np.diff(run_range), 1)) + 1
    for begin, end in zip(np.append(0, ends[:-1]), ends, strict=True):
        runs = by_range[begin:end]
        own_pairs = pair[runs]  # in order
        heads_at = np.flatnonzero(np.append(True, own_pairs[1:] != own_pairs[:-1]))
        own, n_runs = own_pairs[heads_at], np.diff(np.append(heads_at, len(runs)))
        held_words = np.zeros(len(words) + 1, bool)
        for ids in (a[own], b[own], third[runs]):
            held_words[ids] = True
        held_words[0] = False
        used, number = np.flatnonzero(held_words), np.cumsum(held_words, dtype=np.int32)
        held = docs[docs_end[begin] - counts[begin] : docs_end[end - 1]]
        # what two sorted words have in common, all words between them have too
        shared = np.append(0, np.minimum.reduceat(heads[: used[-1]], used[:-1]) if len(used) > 1 else heads[:0])
        tails = _parts(flat, word_ends[used - 1] + shared, word_ends[used])[:-1]
        yield int(run_range[begin]), pack(
            heads=shared, tails=tails, first=np.diff(number[a[own]], prepend=0), second=_steps(number[b[own]], a[own]), n_runs=n_runs, third=number[third[runs]], counts=counts[begin:end], docs=held
        )


BLOCKS = "block string, range long, runs binary, n_words array<long>"


def _blocks(n_ranges: int, kind: pa.DataType):
    """A function from batches of texts to packed runs by range, and a row with the documents of each block."""

    def rows(name: str, known: dict[bytes, int], ids: list, texts: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))  # most places are then in documents of small numbers
        ids, texts = [ids[i] for i in order], [texts[i] for i in order]
        kinds = [pa.string(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(kind)]
        row = lambda r, runs, n, i: pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((name, r, runs, n, i), kinds, strict=True)], ["block", "range", "runs", "n_words", "doc_ids"])
        yield row(zlib.crc32(name.encode()) % n_ranges, None, [len(t) for t in texts], ids)
        for r, runs in _block(known, texts, n_ranges):
            yield row(r, runs, None, None)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, k, size = TaskContext.get().partitionId(), 0, 0
        known = _numbers()
        ids: list = []
        texts: list[np.ndarray] = []
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id"), batch.column("text"), strict=True):
                doc_id, words = doc_id.as_py(), words_of(text.as_py())
                texts.append(np.fromiter(map(known.__getitem__, words), np.int32, len(words)))
                ids.append(doc_id)
                size += len(words) + 8
                if size >= BLOCK_WORDS:
                    yield from rows(f"{task}-{k}", known, ids, texts)
                    k, size, known, ids, texts = k + 1, 0, _numbers(), [], []
                    pa.default_memory_pool().release_unused()
        if ids:
            yield from rows(f"{task}-{k}", known, ids, texts)
            pa.default_memory_pool().release_unused()

    return of


def _hashed(state: np.ndarray, of: np.ndarray, words: list[bytes], more: np.ndarray) -> np.ndarray:
    """The hashes of strings that go on from those with hash ``state[of]`` by a word each."""
    out = np.empty(len(of), np.uint32)
    for k in range(0, len(of), 100_000):
        part = slice(k, k + 100_000)
        out[part] = [zlib.crc32(words[j], s) for j, s in zip(more[part].tolist(), state[of[part]].tolist(), strict=True)]
    return out


def _features(buckets: int):
    """A function from all packed runs of a range to its sums by bucket, and the buckets and documents of each block's runs."""

    def of(pdf: pd.DataFrame) -> pd.DataFrame:
        blobs = [(block, unpack(x)) for block, x in zip(pdf["block"], pdf["runs"], strict=True) if x is not None]
        known = _numbers()
        firsts, seconds, thirds = [], [], []
        for _, x in blobs:
            words = sorted_words(x.pop("heads"), x.pop("tails").tobytes())
            ids = np.append(np.int32(0), np.fromiter(map(known.__getitem__, words), np.int32, len(words)))
            first = x.pop("first").astype(np.int64)
            firsts.append(np.repeat(ids[np.cumsum(first)], x["n_runs"]))
            seconds.append(np.repeat(ids[_summed(x.pop("second").astype(np.int64), first)], x["n_runs"]))
            thirds.append(ids[x.pop("third")])
        out = pdf.loc[pdf["runs"].isna(), ["block", "n_words", "doc_ids"]].assign(features=None, sums=None)
        if not blobs:
            return out
        a, b, pair, third, run_of = _distinct(*(np.concatenate(x) for x in (firsts, seconds, thirds)), len(known))
        del firsts, seconds, thirds
        counts = np.bincount(run_of, np.concatenate([x["counts"] for _, x in blobs]), len(pair)).astype(np.int64)
        one, one_of = np.unique(a, return_inverse=True)
        words = [b"", *known]
        state = np.array([zlib.crc32(words[i]) for i in one.tolist()], np.uint32)
        of_one = state % buckets
        words = [b"", *(b" " + w for w in known)]
        state = _hashed(state, one_of, words, b)
        of_pair = np.where(b > 0, state % buckets, buckets).astype(np.int32)
        of_run = np.where(third > 0, _hashed(state, pair, words, third) % buckets, buckets).astype(np.int32)
        del words, state, known
        of_first = of_one[one_of][pair]
        sums = sum(np.bincount(x, counts, buckets + 1) for x in (of_first, of_pair[pair], of_run))[:buckets].astype(np.int64)
        begin, packed = 0, []
        for block, x in blobs:
            runs = run_of[begin : begin + len(x["counts"])]
            begin += len(runs)
            heads = np.cumsum(x["n_runs"]) - x["n_runs"]
            own = pair[runs[heads]]
            packed.append((block, pack(one=of_one[one_of][own], two=of_pair[own], n_runs=x["n_runs"], three=of_run[runs], counts=x["counts"], docs=x["docs"])))
        made = pd.DataFrame({"block": [None, *(p[0] for p in packed)], "features": [None, *(p[1] for p in packed)]}).assign(n_words=None, doc_ids=None)
        made["sums"] = [sums.tolist(), *[None] * len(packed)]
        return pd.concat([out, made], ignore_index=True)[["block", "features", "sums", "n_words", "doc_ids"]]

    return of


def dictionary(docs: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """Rows of three kinds: sums (one array for each range), features of a block in a range, and documents of a block.

    Written to the shared folder: what follows reads it twice."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    n_ranges = max(1, -(-chars // RANGE_CHARS))
    blocks = only(docs, "doc_id", "text").mapInArrow(_blocks(n_ranges, to_arrow_type(docs.schema["doc_id"].dataType)), f"{BLOCKS}, doc_ids array<{kind}>")
    held = blocks.groupBy("range").applyInPandas(_features(buckets), f"block string, features binary, sums array<long>, n_words array<long>, doc_ids array<{kind}>")
    with batches_of(docs.sparkSession, ROWS):
        return settle(held, "features")


def bucket_counts(features: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Features in each bucket: as many numbers as there are buckets, whatever the texts."""
    sums = features.filter("sums IS NOT NULL").select(F.posexplode("sums").alias("bucket", "n")).groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for r in sums.filter("n > 0").collect():
        out[r.bucket] = r.n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the logarithm of a bucket's share in the target over that in the source, each bucket counted once more."""
    s, t, n = source.astype(float), target.astype(float), len(source)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + n) / ((s + 1) * (t.sum() + n)))).astype(np.int64)


def _block_weights(gain: np.ndarray):
    """A function from features of a block in a range to the sums of their gains for each document that has any."""
    padded = np.append(gain, 0).astype(np.float64)

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            parts = []
            for packed in pdf["features"]:
                if packed is None:
                    parts.append(None)
                    continue
                x = unpack(packed)
                of_run = np.repeat(padded[x["one"]] + padded[x["two"]], x["n_runs"]) + padded[x["three"]]
                docs = x["docs"].astype(np.int64)
                weights = np.bincount(docs, np.repeat(of_run, x["counts"]))
                there = np.flatnonzero(np.bincount(docs))
                found = weights[there].astype(np.int64)
                parts.append(pack(places=np.diff(there, prepend=0), up=np.maximum(found, 0), down=np.maximum(-found, 0)))
            pdf["weights"] = parts
            yield pdf[["block", "weights", "n_words", "doc_ids"]]

    return of


def _sum_block(pdf: pd.DataFrame) -> pd.DataFrame:
    """Documents of a block with the weights that its ranges give them."""
    docs = pdf[pdf["n_words"].notna()].iloc[0]
    n_words, total = np.array(docs["n_words"], np.int64), np.zeros(len(docs["n_words"]), np.int64)
    for packed in pdf["weights"].dropna():
        x = unpack(packed)
        total[np.cumsum(x["places"], dtype=np.int64)] += x["up"].astype(np.int64) - x["down"].astype(np.int64)
    return pd.DataFrame({"doc_id": pd.Series(list(docs["doc_ids"]), dtype=object), "n_words": n_words, "n_features": n_features(n_words), "weight": total})


def weigh(docs: DataFrame, target: DataFrame, key: str = "item_id", buckets: int = BUCKETS) -> DataFrame:
    """doc_id, n_words, n_features and weight of each row of ``docs``, towards the texts of ``target``.

    Null and empty texts have no feature and weight 0; very long ones are a block of their own and counted whole; repeated
    rows are weighed and counted each, null ids stay null. An empty target or an empty table is smoothed like any other.
    Other columns are not read."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    features = dictionary(docs, buckets)
    wanted = dictionary(target.select(F.col(f"`{key}`").alias("doc_id"), "text"), buckets)
    gain = gains(bucket_counts(features, buckets), bucket_counts(wanted, buckets))
    held = features.filter("block IS NOT NULL").select("block", "features", "n_words", "doc_ids")
    parts = held.mapInPandas(_block_weights(gain), f"block string, weights binary, n_words array<long>, doc_ids array<{kind}>")
    with batches_of(docs.sparkSession, ROWS):
        return settle(parts.groupBy("block").applyInPandas(_sum_block, f"doc_id {kind}, n_words long, n_features long, weight long"), "weights")


def noise(seed: int, doc_id: Column) -> Column:
    """Thousandths of a Gumbel variate of the id (a null one is hashed as an empty string)."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.ln(-F.ln((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def ranked(rows: DataFrame, order: list[Column], n: int) -> DataFrame:
    """``rows`` with rank: 1 to n in that order, null beyond. Sorted by ranges; the sizes of the ranges alone meet in a task."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    placed = settle(placed.withColumn("part", F.spark_partition_id()).withColumn("place", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)), "ordered")
    sizes = placed.groupBy(F.col("part").alias("of")).agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("of", F.coalesce(F.sum("n").over(Window.orderBy("of").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    rank = F.col("before") + F.col("place") + 1
    return placed.join(F.broadcast(before), F.col("part") == F.col("of")).withColumn("rank", F.when(rank <= n, rank)).drop("part", "place", "of", "before")


def resample(docs: DataFrame, target: DataFrame, percent: int = 5, least_words: int = 20, seed: int = 42) -> DataFrame:
    """doc_id, n_features, weight, score and rank of each row: those of the highest scores are drawn, as many as ``percent``
    of the rows with at least ``least_words`` words; the rank of all others is null.

    Ties go by doc_id (null last), then features and weight. See ``weigh`` for odd texts and rows."""
    rows = weigh(docs, target).withColumn("score", F.col("weight") + noise(seed, F.col("doc_id")))
    fit = F.col("n_words") >= least_words
    n = rows.filter(fit).count() * percent // 100
    order = [F.when(fit, 0).otherwise(1).asc(), F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("n_features").asc(), F.col("weight").asc()]
    return ranked(rows, order, n).select("doc_id", "n_features", "weight", "score", "rank")


_TABLE = "(SELECT list(list_reduce([c] || range(8), lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END) ORDER BY c) FROM range(256) r(c))"
_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE = rf"""
WITH t AS (SELECT {_TABLE} AS tbl),
w AS (SELECT 0 AS side, doc_id AS id, row_number() OVER () AS k, {_WORDS} AS ws FROM documents UNION ALL SELECT 1, item_id, -row_number() OVER (), {_WORDS} FROM benchmark),
g AS (
  SELECT side, k, unnest(list_concat(ws, list_concat(
    list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]), list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])))) AS gram
  FROM w
), n AS (SELECT side, k, gram, count(*)::BIGINT AS n FROM g GROUP BY ALL),
d AS (SELECT DISTINCT gram, hex(encode(gram)) AS x FROM n),
c AS (
  SELECT gram, xor(list_reduce([4294967295::BIGINT] || list_transform(range(1, len(x), 2), lambda i: ('0x' || x[i:i + 1])::BIGINT),
         lambda s, b: xor(s // 256, tbl[xor(s % 256, b) + 1])), 4294967295) % 10000 AS bucket FROM d, t
), b AS (
  SELECT bucket, coalesce(sum(n) FILTER (side = 0), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (side = 1), 0)::DOUBLE AS t FROM n JOIN c USING (gram) GROUP BY bucket
), tot AS (SELECT sum(s) AS ss, sum(t) AS tt FROM b),
v AS (SELECT bucket, floor(1000 * ln((t + 1) * (ss + 10000) / ((s + 1) * (tt + 10000))))::BIGINT AS gain FROM b, tot),
p AS (SELECT k, sum(n * gain)::BIGINT AS weight FROM n JOIN c USING (gram) JOIN v USING (bucket) WHERE side = 0 GROUP BY k),
r AS (
  SELECT id AS doc_id, len(ws)::BIGINT AS nw, (len(ws) + greatest(len(ws) - 1, 0) + greatest(len(ws) - 2, 0))::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
         coalesce(weight, 0)::BIGINT + floor(-1000 * ln(-ln((('0x' || sha256('42:' || coalesce(id::VARCHAR, ''))[1:8])::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
  FROM w LEFT JOIN p USING (k) WHERE side = 0
), o AS (
  SELECT *, row_number() OVER (ORDER BY nw < 20, score DESC, doc_id NULLS LAST, n_features, weight) AS place, (count(*) FILTER (nw >= 20) OVER () * 5) // 100 AS m FROM r
)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= m THEN place END::BIGINT AS rank FROM o
"""
