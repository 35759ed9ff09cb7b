"""Ordered folds of a key's values: smoothing, change points, bursts, cooldowns.

Rows are put in order within partitions of the key and streamed through Arrow batches; only the fold's state of the
current key is held, so a key may have any number of rows. Null values are passed over. Shard by the key only.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def sliced(batches: Iterable, rows: int = 1000) -> Iterator:
    """Batches of at most so many rows, as all of a batch's rows become Python objects."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def joined(batches: Iterable, rows: int = 10_000, size: int = 1 << 22) -> Iterator:
    """Batches put together while they have fewer rows and bytes, for work that costs much a batch and little a row."""
    import pyarrow as pa

    def whole(parts: list):
        return pa.concat_batches(parts) if len(parts) > 1 else parts[0]

    held: list = []
    for batch in batches:
        if held and (sum(b.num_rows for b in held) + batch.num_rows > rows or sum(b.nbytes for b in held) + batch.nbytes > size):
            yield whole(held)
            held = []
        held.append(batch)
    if held:
        yield whole(held)


def objects(column) -> list:
    """Python values of an Arrow column. Numbers, texts and bytes go through numpy, which takes a fraction of to_pylist's time."""
    import pyarrow as pa

    t, kinds = column.type, pa.types
    if kinds.is_string(t) or kinds.is_binary(t):
        return column.to_numpy(zero_copy_only=False).tolist()
    if not (kinds.is_integer(t) or kinds.is_boolean(t) or kinds.is_float64(t)):
        return column.to_pylist()
    if not column.null_count:
        return column.to_numpy(zero_copy_only=False).tolist()
    values = column.fill_null(False if kinds.is_boolean(t) else 0).to_numpy(zero_copy_only=False).astype(object)
    values[column.is_null().to_numpy(zero_copy_only=False)] = None
    return values.tolist()


#: Rows of a partition where the number of rows is known.
ROWS = 200_000


def parts_for(spark: SparkSession, rows: int) -> int:
    """Partitions for so many rows: enough that a task's memory stays the same however many there are."""
    return max(spark.sparkContext.defaultParallelism, -(-rows // ROWS))


def ordered_fold(rows: DataFrame, key: str | list[str], columns: list[str], start: Callable[[], list], step: Callable[..., Iterable[tuple]], schema: str, finish: Callable[[list], Iterable[tuple]] = lambda _: (), order: tuple[str, ...] = ("us", "seq"), placed: bool = False, parts: int | None = None) -> DataFrame:
    """key columns and `schema`: what step(state, order and column values) and, after a key's last row, finish(state) give.

    The state is a list that step changes in place. Rows with a null key are one key. placed: rows of a key are in one partition
    already, as after another fold by some of its columns, so they are only sorted. parts: how many partitions (None: the session's).
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType, _parse_datatype_string

    keys = [key] if isinstance(key, str) else list(key)
    needed = list(dict.fromkeys([*keys, *order, *columns]))
    out = StructType([rows.schema[k] for k in keys] + _parse_datatype_string(schema).fields)

    def run(batches):
        import pyarrow as pa

        form, nothing = to_arrow_schema(out), object()
        now, state = nothing, []

        def turned(made: list[tuple]):
            columns = zip(*made, strict=True) if made else [()] * len(form)
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, form, strict=True)], schema=form)

        for batch in sliced(batches):
            made = []
            values = {c: objects(batch.column(c)) for c in needed}
            for k, row in zip(zip(*[values[c] for c in keys], strict=True), zip(*[values[c] for c in (*order, *columns)], strict=True), strict=True):
                if k != now:
                    if now is not nothing:
                        made += [(*now, *r) for r in finish(state)]
                    now, state = k, start()
                if got := step(state, *row):
                    made += [(*k, *r) for r in got]
            yield turned(made)
        if now is not nothing:
            yield turned([(*now, *r) for r in finish(state)])

    chosen = rows.select(*needed)
    return (chosen if placed else chosen.repartition(*([parts] if parts else []), *keys)).sortWithinPartitions(*keys, *order).mapInArrow(run, out)


def annotated(rows: DataFrame, key: str | list[str], columns: list[str], start: Callable[[], list], step: Callable[..., tuple], schema: str, order: tuple[str, ...] = ("us", "seq")) -> DataFrame:
    """`rows` with the columns of `schema`: what step(state, column values) gives for each row of a key, in order.

    Other columns go through as they are, so a row needs no number of its own to be found again.
    """
    from pyspark.sql.types import StructType, _parse_datatype_string

    keys, more = [key] if isinstance(key, str) else list(key), _parse_datatype_string(schema)
    kept = [f for f in rows.schema.fields if f.name not in more.names]
    needed = list(dict.fromkeys([*keys, *columns]))
    spare = {c: f"__in_{c}" for c in needed if c in more.names}

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        form, nothing = to_arrow_schema(more), object()
        now, state = nothing, []
        for batch in sliced(batches):
            values = {c: objects(batch.column(spare.get(c, c))) for c in needed}
            made = []
            for k, row in zip(zip(*[values[c] for c in keys], strict=True), zip(*[values[c] for c in columns], strict=True), strict=True):
                if k != now:
                    now, state = k, start()
                made.append(step(state, *row))
            told = [pa.array([m[i] for m in made], f.type) for i, f in enumerate(form)]
            yield pa.RecordBatch.from_arrays([*[batch.column(f.name) for f in kept], *told], names=[*[f.name for f in kept], *form.names])

    chosen = rows.select(*[f.name for f in kept], *[F.col(c).alias(n) for c, n in spare.items()])
    put = lambda c: spare.get(c, c)
    return chosen.repartition(*[put(k) for k in keys]).sortWithinPartitions(*[put(c) for c in (*keys, *order)]).mapInArrow(run, StructType(kept + more.fields))


def ewma(packets: DataFrame, key: str, value: str, alpha: float) -> DataFrame:
    """key, n, ewma: the first value seeds; then alpha * x + (1 - alpha) * mean."""

    def step(s, us, seq, x):
        s[:] = [s[0] + 1, x if not s[0] else alpha * x + (1 - alpha) * s[1]]
        return ()

    return ordered_fold(packets.filter(F.col(value).isNotNull()), key, [value], lambda: [0, 0.0], step, "n long, ewma double", lambda s: [tuple(s)])


def ewma_variance(packets: DataFrame, key: str, value: str, alpha: float) -> DataFrame:
    """key, mean, variance of an exponentially weighted mean and variance."""

    def step(s, us, seq, x):
        d = x - s[1] if s[0] else 0.0
        s[:] = [1, s[1] + alpha * d, (1 - alpha) * (s[2] + d * alpha * d)] if s[0] else [1, x, 0.0]
        return ()

    return ordered_fold(packets.filter(F.col(value).isNotNull()), key, [value], lambda: [0, 0.0, 0.0], step, "mean double, variance double", lambda s: [(s[1], s[2])])


def z_scores(packets: DataFrame, key: str, value: str, alpha: float) -> DataFrame:
    """key, us, seq, z: each value's distance from the smoothed mean before it, in deviations; 0 without a deviation."""

    def step(s, us, seq, x):
        sd = math.sqrt(s[2])
        z = (x - s[1]) / sd if s[0] and sd > 1e-9 else 0.0
        d = x - s[1] if s[0] else 0.0
        s[:] = [1, s[1] + alpha * d, (1 - alpha) * (s[2] + d * alpha * d)] if s[0] else [1, x, 0.0]
        return [(us, seq, z)]

    return ordered_fold(packets.filter(F.col(value).isNotNull()), key, [value], lambda: [0, 0.0, 0.0], step, "us long, seq long, z double")


def cusum(packets: DataFrame, key: str, value: str, target: float, slack: float, limit: float) -> DataFrame:
    """key, n_up, n_down: alarms of a two-sided cumulative sum. Only the side that fires starts anew; up comes first."""

    def step(s, us, seq, x):
        hi, lo = max(0.0, s[0] + x - target - slack), max(0.0, s[1] + target - x - slack)
        up, down = hi > limit, hi <= limit and lo > limit
        s[:] = [0.0 if up else hi, 0.0 if down else lo, s[2] + up, s[3] + down]
        return ()

    return ordered_fold(packets.filter(F.col(value).isNotNull()), key, [value], lambda: [0.0, 0.0, 0, 0], step, "n_up long, n_down long", lambda s: [(s[2], s[3])])


def page_hinkley(packets: DataFrame, key: str, value: str, delta: float, limit: float) -> DataFrame:
    """key, n_alarms: rises of the mean. The running mean goes on after an alarm, the accumulators start anew."""

    def step(s, us, seq, x):
        n = s[0] + 1
        mean = s[1] + (x - s[1]) / n
        total = s[2] + x - mean - delta
        least = min(s[3], total)
        fired = total - least > limit
        s[:] = [n, mean, 0.0 if fired else total, 0.0 if fired else least, s[4] + fired]
        return ()

    return ordered_fold(packets.filter(F.col(value).isNotNull()), key, [value], lambda: [0, 0.0, 0.0, 0.0, 0], step, "n_alarms long", lambda s: [(s[4],)])


def cooled(hits: DataFrame, key: str | list[str], cooldown_us: int, at_equality: bool = False) -> DataFrame:
    """Hits (us, seq) of a key that come more than the cooldown after the last one that counted (or exactly at it)."""

    def step(s, us, seq):
        if s and (us - s[0] < cooldown_us if at_equality else us - s[0] <= cooldown_us):
            return ()
        s[:] = [us]
        return [(us, seq)]

    return ordered_fold(hits, key, [], list, step, "us long, seq long")


def bursts(events: DataFrame, key: str, kind: str, burst: str, threshold: int, window_us: int, trigger: str | None = None) -> DataFrame:
    """key, us, seq, n: moments at which `threshold` burst events lie in the window.

    Without a trigger the event that reaches the threshold fires; with one, a trigger event does while enough are live.
    Firing clears the key's events, so at most `threshold` times are held without a trigger.
    """

    def step(s, us, seq, name):
        s[:] = [t for t in s if us - t <= window_us]
        if name == burst:
            s.append(us)
            if len(s) > threshold:
                del s[0]  # older ones make no difference to whether enough are live
        fired = len(s) >= threshold and (name == burst if trigger is None else name == trigger)
        if not fired:
            return ()
        n = len(s)
        s.clear()
        return [(us, seq, n)]

    return ordered_fold(events, key, [kind], list, step, "us long, seq long, n int")


def sequences(events: DataFrame, key: str, kind: str, pattern: list[str], within_us: int) -> DataFrame:
    """key, us, seq: ends of `pattern` as a subsequence of a key's events, all within `within_us` of its first one.

    The state is the start of the latest attempt at each length of the pattern; a match starts everything anew.
    """

    def step(s, us, seq, name):
        for i in reversed(range(len(pattern))):
            begun = us if i == 0 else s[i - 1]
            if name == pattern[i] and begun is not None and us - begun <= within_us:
                s[i] = begun
        if s[-1] is None:
            return ()
        s[:] = [None] * len(pattern)
        return [(us, seq)]

    return ordered_fold(events, key, [kind], lambda: [None] * len(pattern), step, "us long, seq long")
