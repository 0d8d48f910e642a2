"""Product codes of integer vectors: exact Lloyd rounds with Hamerly's bounds.

Vectors become whole numbers, floor(scale * x), and are cut into equal parts; each part position has a codebook, which
starts as the parts of the first vectors by id. A round assigns every part to its nearest entry (squared Euclidean
distance, ties to the lower index) and replaces each entry by its parts' componentwise floor(sum / count).

Between rounds each part keeps its entry, an upper bound of its distance to it and one lower bound of the distance to
the second nearest. After the entries have moved, the upper bound grows by its own entry's move, the lower one
shrinks by the largest move of any other entry. A part is left where it is only if the upper bound, or else the exact distance, is
strictly below the lower bound or half of its entry's distance to the next entry, with a margin for rounding; then no other
entry can be as near, so ties are never decided by a bound. All others are scanned against the whole codebook in whole numbers.

The state of a round is a table in the shared folder, so a lost executor costs a task; the table of the round before is deleted
once the next is complete. Only codebooks (entries x dimension numbers) come to the driver and go to the tasks. Sums are
made by Spark with partial aggregation, so an entry that most parts choose is no hot key.

Defined results: rows whose vector is null, empty, or holds null or non-finite components are dropped, and so are those whose
length isn't the most frequent one (of equally frequent ones, the smallest), for they have no place in the codebooks; a length that isn't
a multiple of the parts is an error. Null ids count as the smallest; equal ids are ordered by their vectors. Fewer vectors than
entries make shorter codebooks. Repeated rows count as often as they occur. A null label is a label of its own. Components so
large that a squared distance could leave 63 bits are an error (``ValueError``), as the errors are longs by contract. No rows give no rows;
columns that aren't named are not read.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_dir, small_side, written

SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
#: Relative margin of the bounds, many times what rounding can add up to.
MARGIN = 1e-9
#: Rows that meet the codebook at once.
ROWS = 1024
#: A label with more than one row in so many is joined by broadcast; so there are fewer such labels than that.
HOT_SHARE = 1000


def _written(df: DataFrame, at: str) -> DataFrame:
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def _delete(spark: SparkSession, at: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def whole_numbers(vector: Column, scale: int = SCALE) -> Column:
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale))


def kept(rows: DataFrame, vector: str) -> DataFrame:
    """Rows with a vector of finite components."""
    broken = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    return rows.where(F.col(vector).isNotNull() & (F.size(vector) > 0) & ~F.coalesce(broken, F.lit(False)))


def distances(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Squared distances of each row to each entry, exact: by a matrix product while its sums are below 2**53 (doubles
    hold them exactly), in longs else."""
    most = int(max(np.abs(x).max(initial=0), np.abs(book).max(initial=0)))
    if 4 * x.shape[1] * most * most < 1 << 53:
        a, b = x.astype(np.float64), book.astype(np.float64)
        return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)[None, :]).astype(np.int64)
    return np.stack([((x - c) ** 2).sum(1) for c in book], axis=1)


class Codebook:
    """The entries of one part position, and how far they have moved since the last round."""

    def __init__(self, entries: np.ndarray, before: np.ndarray | None = None):
        self.entries = entries
        between = distances(entries, entries).astype(np.float64)
        np.fill_diagonal(between, np.inf)
        self.half = np.sqrt(between.min(1)) / 2 * (1 - MARGIN)
        if before is not None:
            self.moved = np.sqrt(((entries - before) ** 2).sum(1).astype(np.float64)) * (1 + MARGIN)
            most = int(self.moved.argmax())
            others = np.delete(self.moved, most)
            self.largest = np.full(len(entries), self.moved[most])  # of the moves of all other entries
            self.largest[most] = others.max(initial=0.0)

    def assign(self, x: np.ndarray, code: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> int:
        """Brings ``code`` and the bounds up to date in place; how many rows were scanned. A negative code is none yet."""
        todo = np.flatnonzero(code < 0)
        known = np.flatnonzero(code >= 0)
        if len(known):
            own = code[known]
            upper[known] = (upper[known] + self.moved[own]) * (1 + MARGIN)
            lower[known] = np.maximum(lower[known] - self.largest[own], 0) * (1 - MARGIN)
            limit = np.maximum(lower[known], self.half[own])
            unsure = known[~(upper[known] < limit)]
            if len(unsure):
                exact = ((x[unsure] - self.entries[code[unsure]]) ** 2).sum(1)
                upper[unsure] = np.sqrt(exact.astype(np.float64)) * (1 + MARGIN)
                todo = np.concatenate([todo, unsure[~(upper[unsure] < np.maximum(lower[unsure], self.half[code[unsure]]))]])
        if len(todo):
            far = distances(x[todo], self.entries)
            best = far.argmin(1)  # the first of equal ones
            at = np.arange(len(todo))
            code[todo] = best
            upper[todo] = np.sqrt(far[at, best].astype(np.float64)) * (1 + MARGIN)
            far[at, best] = np.iinfo(np.int64).max
            lower[todo] = np.sqrt(far.min(1).astype(np.float64)) * (1 - MARGIN) if len(self.entries) > 1 else np.inf
        return len(todo)


def _matrix(lists: pa.ListArray, width: int) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _lists(matrix: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    offsets = pa.array(np.arange(len(matrix) + 1, dtype=np.int32) * matrix.shape[1])
    return pa.ListArray.from_arrays(offsets, pa.array(matrix.ravel(), kind))


def assigned(state: DataFrame, books: list[np.ndarray], before: list[np.ndarray] | None, final: bool = False) -> DataFrame:
    """``state`` (v: whole numbers; code, upper, lower: a value for each part) brought up to date for ``books``; in the
    ``final`` pass the bounds become the row's ``error``."""
    parts, width = len(books), books[0].shape[1]
    sent = state.sparkSession.sparkContext.broadcast((books, before))
    others = [c for c in state.columns if c not in ("v", "code", "upper", "lower")]
    kinds = dict(state.dtypes)
    kept_columns = others if final else [*others, "v"]
    more = ["code array<int>", "error bigint"] if final else ["code array<int>", "upper array<double>", "lower array<double>"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        new, old = sent.value
        codebooks = [Codebook(b, old[p] if old else None) for p, b in enumerate(new)]
        for batch in batches:
            v, code = _matrix(batch.column("v"), parts * width), _matrix(batch.column("code"), parts).astype(np.int64)
            upper, lower = (_matrix(batch.column(c), parts).copy() for c in ("upper", "lower"))
            error = np.zeros(len(v), np.int64)
            for start in range(0, len(v), ROWS):
                at = slice(start, start + ROWS)
                for p, book in enumerate(codebooks):
                    part, c, u, low = v[at, p * width : (p + 1) * width].astype(np.int64), code[at, p], upper[at, p], lower[at, p]
                    book.assign(part, c, u, low)  # these are views: changed in place
                    if final:
                        error[at] += ((part - book.entries[c]) ** 2).sum(1)
            out = [batch.column(c) for c in kept_columns] + [_lists(code.astype(np.int32), pa.int32())]
            out += [pa.array(error)] if final else [_lists(upper, pa.float64()), _lists(lower, pa.float64())]
            yield pa.RecordBatch.from_arrays(out, names=[*kept_columns, *(m.split()[0] for m in more)])

    return state.mapInArrow(run, ", ".join([*(f"{c} {kinds[c]}" for c in kept_columns), *more]))


def _moved(state: DataFrame, books: list[np.ndarray]) -> list[np.ndarray]:
    """The entries replaced by the floor of the mean of their parts; unused ones stay."""
    width = books[0].shape[1]
    each = F.explode(F.expr(f"transform(code, (c, p) -> struct(p AS part, c AS entry, slice(v, p * {width} + 1, {width}) AS x))"))
    parts = state.select(each.alias("e")).select("e.*")
    sums = parts.groupBy("part", "entry").agg(F.count("*").alias("n"), *[F.sum(F.col("x")[i].cast("long")).alias(f"s{i}") for i in range(width)])
    out = [b.copy() for b in books]
    for r in sums.collect():  # parts x entries rows at most
        out[r.part][r.entry] = [r[f"s{i}"] // r.n for i in range(width)]
    return out


def books_digest(books: list[np.ndarray]) -> str:
    """Lowercase hex SHA-256 of all components in decimal, by part, entry, and position, joined by commas."""
    return hashlib.sha256(",".join(str(int(x)) for b in books for x in b.ravel()).encode()).hexdigest()


def encode(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, list[np.ndarray]]:
    """((key, label, code array<int>, error long) for each kept row, the final codebooks)."""
    spark = rows.sparkSession
    folder = f"{shared_dir(spark)}/codes-{uuid.uuid4().hex}"
    found = kept(rows.select(F.col(key).alias("__id"), F.col(label).alias("__label"), F.col(vector).alias("__v")), "__v")
    lengths = found.groupBy(F.size("__v").alias("n")).agg(F.count("*").alias("rows"), F.max(F.array_max(F.transform("__v", lambda x: F.abs(x.cast("double"))))).alias("most"))
    first = lengths.orderBy(F.desc("rows"), "n").first()
    shape = "__id {}, __label {}".format(*[dict(found.dtypes)[c] for c in ("__id", "__label")])
    if first is None:
        return spark.createDataFrame([], f"{shape}, code array<int>, error bigint"), []
    n = first["n"]
    if n % parts:
        raise ValueError(f"vectors of {n} components can't be cut into {parts} equal parts")
    if (2 * (first["most"] * scale + 1)) ** 2 * n >= 2.0**62 or first["most"] * scale * first["rows"] >= 2.0**62:
        raise ValueError("components are too large for whole-number errors of 63 bits")
    kind = "int" if first["most"] * scale < 2**31 - 2 else "bigint"
    filled = [F.array(*[F.lit(x)] * parts).cast(f"array<{t}>") for x, t in ((-1, "int"), (0, "double"), (0, "double"))]
    numbers = found.where(F.size("__v") == n).select("__id", "__label", whole_numbers(F.col("__v"), scale).cast(f"array<{kind}>").alias("v"))
    smallest = numbers.select("__id", "v").orderBy(F.col("__id").asc_nulls_first(), "v").limit(entries).collect()
    width = n // parts
    whole = np.array([r.v for r in smallest], dtype=np.int64)
    books = [whole[:, p * width : (p + 1) * width].copy() for p in range(parts)]
    state, before, at = numbers.select("*", *[c.alias(x) for c, x in zip(filled, ("code", "upper", "lower"), strict=True)]), None, None
    for k in range(rounds):
        nxt = f"{folder}/round-{k}"
        state = _written(assigned(state, books, before), nxt)
        if at:
            _delete(spark, at)
        before, books, at = books, _moved(state, books), nxt
    done = _written(assigned(state, books, before, final=True), f"{folder}/codes")
    if at:
        _delete(spark, at)
    return done, books


def code_text(code: Column, entries: int = ENTRIES) -> Column:
    """The indexes in part order, as hex digits, two for 256 entries."""
    digits = max(1, -(-(entries - 1).bit_length() // 4))
    return F.lower(F.array_join(F.transform(code, lambda c: F.lpad(F.hex(c), digits, "0")), ""))


def label_errors(codes: DataFrame, label: str = "__label", most: int | None = None) -> DataFrame:
    """``codes`` (a written table) with ``label_error``, the sum of ``error`` over rows of an equal label. Totals are made by
    partial aggregation; they are broadcast if their measured bytes are small, or else joined, with frequent labels apart."""
    rows = codes.count()
    match = F.col(f"`{label}`").eqNullSafe(F.col("__of"))
    grouped = codes.groupBy(F.col(f"`{label}`").alias("__of")).agg(F.sum("error").alias("label_error"), F.count("*").alias("__n"))
    totals = written(grouped, "labels")
    if (side := small_side(totals, most)) is not totals:
        return codes.join(side, match).drop("__of", "__n")
    frequent = F.col("__n") * HOT_SHARE > rows
    first = codes.join(F.broadcast(totals.where(frequent)), match, "left")
    rest = first.where("__n IS NULL").drop("__of", "label_error", "__n").join(totals.where(~frequent), match)
    return first.where("__n IS NOT NULL").unionByName(rest).drop("__of", "__n")
