"""Problem 3: consensus of contributors' votes by a community confusion model.

Every contributor belongs to one of a few communities; a community has one confusion matrix for each list of options (how often
it gives option v where t is right). Tasks' answers, contributors' communities and the matrices are inferred together by
variational updates, tasks with a gold answer being fixed. A contributor's own matrix is the community's, moved by their own
votes: PRIOR_VOTES votes' worth of the community's behaviour stabilise contributors with few votes.

All tables stay distributed, those of the matrices too: a step joins the votes with two of them, sums in Arrow batches what the
votes say of tasks, contributors or lists before anything is shuffled, and settles the sums. Only a few sums a step reach the
driver.

Defined results: a vote counts if flagged_spam is false (null isn't), it is the contributor's latest on the task among those
(ties by loaded_at, then id), and its value names an option; votes without task, contributor or value don't count. Options that
differ only in spelling are the first of them. A task without options has no answer. Equal posteriors: the earlier option.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from corvane.session import ship, stage, table, unstage

#: Share of right answers the communities start from: reliable, fair, guessing, contrary.
START = (0.9, 0.65, 0.4, 0.15)
PRIOR_VOTES = 8.0
ROUNDS, TOLERANCE = 12, 1e-3
MIN_VOTES = 3


def spelled(c: str | Column) -> Column:
    """A value apart from case, outer blanks, a closing full stop and `_` for a blank."""
    c = F.col(c) if isinstance(c, str) else c
    outer = r"^[\s\p{Z}]+|[\s\p{Z}]+$"
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(F.translate(F.lower(c), "_", " "), outer, ""), r"\.$", ""), outer, "")


def counted(votes: DataFrame, tasks: DataFrame) -> DataFrame:
    """(task_id, contributor_id, list, n_options, v): the votes that count; v is the option's place from 0, list the task's options as one string."""
    last = votes.where("flagged_spam = false and task_id is not null and contributor_id is not null").groupBy("task_id", "contributor_id").agg(F.max(F.struct("created_at", "loaded_at", "id", "value")).alias("last"))
    options = tasks.where("id is not null and options is not null").groupBy(F.col("id").alias("task_id")).agg(F.max("options").alias("options"))
    places = options.select("task_id", F.to_json("options").alias("list"), F.size("options").alias("n_options"), F.transform("options", lambda o: spelled(o)).alias("names"))
    named = last.join(places, "task_id").select("task_id", "contributor_id", "list", "n_options", (F.array_position("names", spelled("last.value")) - 1).cast("int").alias("v"))
    return named.where("v >= 0")


def _digamma(x: np.ndarray) -> np.ndarray:
    x, out = np.array(x, float), np.zeros(np.shape(x))
    for _ in range(6):
        out -= 1 / x
        x = x + 1
    return out + np.log(x) - 1 / (2 * x) - 1 / (12 * x**2) + 1 / (120 * x**4) - 1 / (252 * x**6)


def _prior(n: int) -> np.ndarray:
    """Pseudo-votes (communities, t, v) of a list of n options."""
    out = np.empty((len(START), n, n))
    for c, right in enumerate(START):
        right = 1 / n if c == 2 else right
        out[c] = (1 - right) / max(n - 1, 1)
        out[c, range(n), range(n)] = right
    return out * 4


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


#: Rows that steps hand on: a sum (of numbers in `vec`) that belongs to a task, a contributor or an option of a list.
PART = "kind int, key string, list long, v int, n int, g int, vec array<double>, who string"
PART_SCHEMA = pa.schema([("kind", pa.int32()), ("key", pa.string()), ("list", pa.int64()), ("v", pa.int32()), ("n", pa.int32()), ("g", pa.int32()), ("vec", pa.list_(pa.float64())), ("who", pa.string())])
TASK, WHO, OPTION, PRIOR, VOTE = range(5)
BASE = ("task_id", "contributor_id", "list", "v", "n", "g")


def _lists(rows: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, rows)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(rows) if rows else np.zeros(0), pa.float64()))


def _parts(rows: list[tuple]) -> pa.RecordBatch:
    """A batch of rows (kind, key, list, v, n, g, vec)."""
    cols = list(zip(*rows)) or [()] * 7
    return pa.RecordBatch.from_arrays([*(pa.array(c, f.type) for c, f in zip(cols[:6], PART_SCHEMA)), _lists(list(cols[6])), pa.nulls(len(rows), pa.string())], schema=PART_SCHEMA)


def _square(col: pa.Array, some: np.ndarray) -> np.ndarray:
    """The lists of some rows, all of one length, as rows of numbers."""
    return pc.list_flatten(col.take(pa.array(some))).to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(some), -1)


def _added(codes: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows of `x` summed by code: (first row of each code, sums)."""
    order = np.argsort(codes, kind="stable")
    cut = np.flatnonzero(np.append(True, codes[order][1:] != codes[order][:-1]))
    return order[cut], np.add.reduceat(x[order], cut, axis=0)


def _emit(kind: int, b: pa.RecordBatch, some: np.ndarray, by: tuple[str, ...], x: np.ndarray) -> pa.RecordBatch:
    """Sums of `x` by the columns `by` of some rows of a batch of votes, as rows of PART."""
    t = b.take(pa.array(some))
    codes = np.zeros(len(some), np.int64)
    for name in by:
        d = pc.dictionary_encode(t.column(name))
        codes = codes * max(len(d.dictionary), 1) + d.indices.to_numpy()
    first, sums = _added(codes, x)
    t = t.take(pa.array(first))
    key = t.column({TASK: "task_id", WHO: "contributor_id"}[kind]) if kind in (TASK, WHO) else pc.cast(t.column("list"), pa.string())
    v = t.column("v") if "v" in by else pa.array([-1] * len(first), pa.int32())
    return pa.RecordBatch.from_arrays([pa.array([kind] * len(first), pa.int32()), key, t.column("list"), v, t.column("n"), t.column("g"), _lists(list(sums)), pa.nulls(len(first), pa.string())], schema=PART_SCHEMA)


def _by_size(b: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
    n = b.column("n").to_numpy()
    for k in np.unique(n):
        yield int(k), np.flatnonzero(n == k)


def _named(v: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros((len(v), n))
    out[np.arange(len(v)), v] = 1
    return out


def _vote_rows(b: pa.RecordBatch) -> pa.RecordBatch:
    """The votes themselves, as rows of PART that follow their tasks' sums."""
    none = pa.ListArray.from_arrays(pa.array(np.zeros(b.num_rows + 1), pa.int32()), pa.array([], pa.float64()))
    return pa.RecordBatch.from_arrays([pa.array([VOTE] * b.num_rows, pa.int32()), b.column("task_id"), b.column("list"), b.column("v"), b.column("n"), b.column("g"), none, b.column("contributor_id")], schema=PART_SCHEMA)


def _first_answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Votes -> what they say of their tasks at first: the options' shares, and the votes for each option."""
    for b in batches:
        for n, some in _by_size(b):
            hot = _named(b.column("v").to_numpy()[some], n)
            yield _emit(TASK, b, some, ("task_id",), np.concatenate([1.5 * hot, hot], axis=1))
        yield _vote_rows(b)


def _answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Votes with q, e and k -> what they say of their tasks, given the contributors' communities. The options' shares count
    once a task, so each of its votes brings a part of them."""
    for b in batches:
        for n, some in _by_size(b):
            q, e = _square(b.column("q"), some), _square(b.column("e"), some).reshape(len(some), len(START), n)
            x = np.einsum("mc,mcn->mn", q, e) + _square(b.column("k"), some) / b.column("n_votes").to_numpy()[some][:, None]
            yield _emit(TASK, b, some, ("task_id",), np.concatenate([x, _named(b.column("v").to_numpy()[some], n)], axis=1))
        yield _vote_rows(b)


@cache
def _start(n: int) -> np.ndarray:
    """(v, communities, t): what the communities' matrices are before any vote."""
    alpha = _prior(n)
    return (_digamma(alpha) - _digamma(alpha.sum(axis=2, keepdims=True))).transpose(2, 0, 1)


def _about_who(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Votes with p and e (if there are matrices yet) -> what they say of their contributors' communities."""
    for b in batches:
        for n, some in _by_size(b):
            e = _square(b.column("e"), some).reshape(len(some), len(START), n) if "e" in b.schema.names else _start(n)[b.column("v").to_numpy()[some]]
            yield _emit(WHO, b, some, ("contributor_id",), np.einsum("mn,mcn->mc", _square(b.column("p"), some), e))


def _about_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Votes with p and q -> what they say of the matrices and of the options' shares."""
    for b in batches:
        for n, some in _by_size(b):
            p, q = _square(b.column("p"), some), _square(b.column("q"), some)
            yield _emit(OPTION, b, some, ("list", "v"), (q[:, :, None] * p[:, None, :]).reshape(len(some), -1))
            yield _emit(PRIOR, b, some, ("list",), p / b.column("n_votes").to_numpy()[some][:, None])


def _runs(batches: Iterator[pa.RecordBatch], by: tuple[str, ...]) -> Iterator[tuple]:
    """Rows of PART sorted by `by` -> (kind, key, list, v, n, g, sum of vec) of each run; nothing but one run's sum is held."""
    held = None
    for b in batches:
        if not b.num_rows:
            continue
        new = np.zeros(b.num_rows, bool)
        new[0] = True
        for name in by:
            c = b.column(name)
            new[1:] |= pc.not_equal(c.slice(1), c.slice(0, b.num_rows - 1)).to_numpy(zero_copy_only=False)
        starts, run = np.flatnonzero(new), np.cumsum(new) - 1
        vec = b.column("vec")
        size = pc.list_value_length(vec).to_numpy()
        out: list = [None] * len(starts)
        for k in np.unique(size):
            some = np.flatnonzero(size == k)
            first, sums = _added(run[some], _square(vec, some))
            for at, s in zip(run[some][first], sums):
                out[at] = s
        rows = [(*r, s) for r, s in zip(zip(*(b.column(i).take(pa.array(starts)).to_pylist() for i in range(6))), out)]
        at = [PART_SCHEMA.names.index(name) for name in by]
        if held is not None:
            if all(held[i] == rows[0][i] for i in at):
                rows[0] = (*rows[0][:6], rows[0][6] + held[6])
            else:
                yield held
        held = rows.pop()
        yield from rows
    if held is not None:
        yield held


def _by_thousands(rows: Iterator[tuple]) -> Iterator[list[tuple]]:
    while part := list(itertools.islice(rows, 4000)):
        yield part


ANSWER = "task_id string, list long, n int, g int, n_votes double, n_each array<double>, p array<double>"
RATED = "task_id string, contributor_id string, list long, v int, n int, g int, n_votes double, p array<double>"


def _posterior(x: np.ndarray, g: np.ndarray) -> np.ndarray:
    """The options' probabilities by their logarithms; where the right option is known (g is not below 0) it is certain."""
    p = _softmax(x)
    p[g >= 0] = _named(g[g >= 0], x.shape[1])
    return p


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What is known of tasks, sorted by task -> their answers (rows of ANSWER)."""
    kinds = (pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.float64())
    for rows in _by_thousands(_runs(batches, ("key",))):
        for n in {r[4] for r in rows}:
            mine = [r for r in rows if r[4] == n]
            x = np.stack([r[6] for r in mine])
            p = _posterior(x[:, :n], np.array([-1 if r[5] is None else r[5] for r in mine]))
            cols = list(zip(*[(r[1], r[2], n, r[5], each.sum()) for r, each in zip(mine, x[:, n:])]))
            yield pa.RecordBatch.from_arrays([*(pa.array(c, k) for c, k in zip(cols, kinds)), _lists(list(x[:, n:])), _lists(list(p))], ["task_id", "list", "n", "g", "n_votes", "n_each", "p"])


def _rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What is known of tasks and then their votes, sorted by task and kind -> the votes with their tasks' answers (rows of RATED).
    A task's sums are complete before its first vote; only the last task's are held from batch to batch."""
    held, last = None, None
    for b in batches:
        if not b.num_rows:
            continue
        key = pc.dictionary_encode(b.column("key"))
        codes, names, kind, n = key.indices.to_numpy(), key.dictionary, b.column("kind").to_numpy(), b.column("n").to_numpy()
        newest = b.column("key")[b.num_rows - 1].as_py()
        for k in np.unique(n):
            told, votes = np.flatnonzero((n == k) & (kind == TASK)), np.flatnonzero((n == k) & (kind == VOTE))
            sums = np.zeros((len(names), 2 * k))
            if len(told):
                first, x = _added(codes[told], _square(b.column("vec"), told))
                sums[codes[told][first]] = x
            if last == names[0].as_py() and len(held) == 2 * k and n[0] == k:
                sums[0] += held
            if newest == names[len(names) - 1].as_py() and n[-1] == k:
                tail = sums[-1]
            if len(votes):
                t = b.take(pa.array(votes))
                g = t.column("g").fill_null(-1).to_numpy()
                x = sums[codes[votes]]
                cols = [t.column("key"), t.column("who"), *(t.column(c) for c in ("list", "v", "n", "g")), pa.array(x[:, k:].sum(axis=1)), _lists(list(_posterior(x[:, :k], g)))]
                yield pa.RecordBatch.from_arrays(cols, ["task_id", "contributor_id", "list", "v", "n", "g", "n_votes", "p"])
        held, last = tail, newest


def _communities(mass: np.ndarray):
    """Sums of contributors, sorted -> (WHO, contributor, q) and one row with the communities' sizes in this task."""
    rho = _digamma(mass) - _digamma(mass.sum())

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(START))
        for rows in _by_thousands(_runs(batches, ("key",))):
            q = _softmax(np.stack([r[6] for r in rows]) + rho)
            total += q.sum(axis=0)
            yield _parts([(WHO, r[1], None, None, None, None, x) for r, x in zip(rows, q)])
        yield _parts([(TASK, None, None, None, None, None, total)])

    return settle


def _matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of lists, sorted by list, kind and option -> (OPTION, list, v, e and mean, logarithmic shares of the list's options) of
    each option named, and one row with the communities' votes for the right option and in all. One list's sums are held."""
    total, held, share, at = np.zeros(2 * len(START)), {}, None, None

    def close() -> list[tuple]:
        if not held:
            return []
        n = next(iter(held.values())).shape[1]
        alpha = _prior(n)
        for v, x in held.items():
            alpha[:, :, v] += x
            total[: len(START)] += x[:, v]
            total[len(START) :] += x.sum(axis=1)
        e, mean = _digamma(alpha) - _digamma(alpha.sum(axis=2, keepdims=True)), alpha / alpha.sum(axis=2, keepdims=True)
        k = _digamma(1 + share) - _digamma((1 + share).sum())
        return [(OPTION, None, at, v, n, None, np.concatenate([e[:, :, v].ravel(), mean[:, :, v].ravel(), k])) for v in held]

    for rows in _by_thousands(_runs(batches, ("list", "kind", "v"))):
        out = []
        for kind, _, name, v, n, _, x in rows:
            if name != at:
                out += close()
                held, at = {}, name
            if kind == OPTION:
                held[v] = x.reshape(len(START), n)
            else:
                share = x
        yield _parts(out)
    yield _parts([*close(), (TASK, None, None, None, None, None, total)])


class Model:
    """The inferred tables: rated votes (see RATED), contributors (contributor_id, q), matrices (list, v, e, mean, k) and answers (see ANSWER)."""

    def __init__(self, votes: DataFrame, rounds: int = ROUNDS) -> None:
        self.votes = self.rate(votes.mapInArrow(_first_answers, PART))
        mass, before, used = np.ones(len(START)), np.zeros(3 * len(START)), []
        for k in range(rounds):
            told = self.votes if k == 0 else self.votes.join(self.matrices.select("list", "v", "e"), ["list", "v"])
            who = told.select(*BASE, "p", *(["e"] if k else [])).mapInArrow(_about_who, PART)
            who = stage(who.repartition("key").sortWithinPartitions("key").mapInArrow(_communities(mass), PART))
            self.contributors = who.where(F.col("kind") == WHO).select(F.col("key").alias("contributor_id"), F.col("vec").alias("q"))
            lists = self.votes.join(self.contributors, "contributor_id").select(*BASE, "p", "q", "n_votes").mapInArrow(_about_lists, PART)
            lists = stage(lists.repartition("list").sortWithinPartitions("list", "kind", "v").mapInArrow(_matrices, PART))
            size = F.col("n") * len(START)
            self.matrices = lists.where(F.col("kind") == OPTION).select("list", "v", F.slice("vec", F.lit(1), size).alias("e"), F.slice("vec", 1 + size, size).alias("mean"), F.slice("vec", 1 + 2 * size, F.col("n")).alias("k"))
            both = self.votes.join(self.contributors, "contributor_id").join(self.matrices.select("list", "v", "e", "k"), ["list", "v"])
            past, self.votes = self.votes, self.rate(both.select(*BASE, "n_votes", "q", "e", "k").mapInArrow(_answers, PART))
            unstage(past, *used)
            used = [who, lists]
            # a row of a few numbers from each task of the two steps
            now = [sum((np.array(r.vec) for r in x.where(F.col("kind") == TASK).select("vec").collect()), np.zeros(m * len(START))) for x, m in ((who, 1), (lists, 2))]
            mass, now = 1 + now[0], np.concatenate(now)
            if np.abs(now - before).sum() <= TOLERANCE * max(now.sum(), 1e-9):
                break
            before = now
        self.own()

    def rate(self, parts: DataFrame) -> DataFrame:
        """The votes with their tasks' answers, by what they say of them (rows of PART, votes included)."""
        return stage(parts.repartition("key").sortWithinPartitions("key", "kind").mapInArrow(_rate, RATED))

    def own(self) -> None:
        """The last step: each contributor's own matrix, the community's being its prior, and the answers by those matrices."""
        counts = self.votes.select(*BASE, "p").mapInArrow(_own_counts, PART)
        counts = counts.repartition("key", "list").sortWithinPartitions("key", "list", "v").mapInArrow(_own_totals, "contributor_id string, list long, v int, own array<double>, total array<double>")
        told = self.votes.join(stage(counts), ["contributor_id", "list", "v"]).join(self.contributors, "contributor_id").join(self.matrices.select("list", "v", "mean", "k"), ["list", "v"])
        told = told.select(*BASE, "n_votes", "p", "q", "mean", "k", "own", "total").mapInArrow(_own_answers, PART)
        self.answers = stage(told.repartition("key").sortWithinPartitions("key").mapInArrow(_settle, ANSWER))


def _own_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Votes with p -> for which options contributors vote, by what is right."""
    for b in batches:
        for _, some in _by_size(b):
            yield _emit(WHO, b, some, ("contributor_id", "list", "v"), _square(b.column("p"), some))


def _own_totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Those sums, sorted by contributor, list and option, with the totals of all options; one contributor's sums of one list are held."""

    def rows() -> Iterator[tuple]:
        for _, mine in itertools.groupby(_runs(batches, ("key", "list", "v")), key=lambda r: (r[1], r[2])):
            mine = list(mine)
            total = sum(r[6] for r in mine)
            yield from ((r[1], r[2], r[3], r[6], total) for r in mine)

    for part in _by_thousands(rows()):
        who, name, v, own, total = zip(*part)
        yield pa.RecordBatch.from_arrays([pa.array(who, pa.string()), pa.array(name, pa.int64()), pa.array(v, pa.int32()), _lists(list(own)), _lists(list(total))], ["contributor_id", "list", "v", "own", "total"])


def _own_answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Votes with all of that -> what they say of their tasks. A vote's own task is left out of its contributor's matrix, else it confirms itself."""
    for b in batches:
        for n, some in _by_size(b):
            p, own, total, q = (_square(b.column(c), some) for c in ("p", "own", "total", "q"))
            base = np.einsum("mc,mcn->mn", q, _square(b.column("mean"), some).reshape(len(some), len(START), n))
            x = np.log((np.maximum(own - p, 0) + PRIOR_VOTES * base + 1e-6) / (np.maximum(total - p, 0) + PRIOR_VOTES))
            x += _square(b.column("k"), some) / b.column("n_votes").to_numpy()[some][:, None]
            yield _emit(TASK, b, some, ("task_id",), np.concatenate([x, _named(b.column("v").to_numpy()[some], n)], axis=1))


def infer(votes: DataFrame, gold: DataFrame, rounds: int = ROUNDS) -> Model:
    """Fit the model to counted votes (see `counted`); gold (task_id, g): the place of the right option where it is known."""
    votes = stage(votes)
    lists = stage(votes.select("list").distinct().select("list", F.monotonically_increasing_id().alias("number")))
    full = votes.join(lists, "list").join(gold, "task_id", "left")
    return Model(stage(full.select("task_id", "contributor_id", F.col("number").alias("list"), F.col("n_options").alias("n"), "v", "g")), rounds)


def gold_places(tasks: DataFrame) -> DataFrame:
    """(task_id, g): the place of the gold answer among the options, where it is given and names one."""
    names = F.transform("options", lambda o: spelled(o))
    g = F.array_position(names, spelled("gold_answer")) - 1
    return tasks.where("id is not null and options is not null and gold_answer is not null").select(F.col("id").alias("task_id"), g.cast("int").alias("g")).where("g >= 0").groupBy("task_id").agg(F.min("g").alias("g"))


def consensus(votes: DataFrame, tasks: DataFrame) -> DataFrame:
    """(task_id, value, n_votes, agreement, confidence): answer, the share of counted votes for it, and its posterior."""
    ship(votes.sparkSession)
    m = infer(counted(votes, tasks), gold_places(tasks))
    best = (F.array_position("p", F.array_max("p")) - 1).cast("int")
    options = tasks.where("id is not null and options is not null").groupBy(F.col("id").alias("task_id")).agg(F.max("options").alias("options"))
    top = m.answers.select("task_id", F.col("n_votes").cast("long").alias("n_votes"), "n_each", "p", best.alias("best")).join(options, "task_id")
    return top.select("task_id", F.col("options")[F.col("best")].alias("value"), "n_votes", (F.col("n_each")[F.col("best")] / F.col("n_votes")).alias("agreement"), F.array_max("p").alias("confidence"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(task_id, value) of every task with at least three counted votes."""
    return consensus(table(spark, sf_dir, "validation_votes"), table(spark, sf_dir, "gold_set")).where(F.col("n_votes") >= MIN_VOTES).select("task_id", "value")


def p3_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(task_id, value, n_votes, agreement, confidence) of every task with a counted vote."""
    return consensus(table(spark, sf_dir, "validation_votes"), table(spark, sf_dir, "gold_set"))


def p3_reliability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(contributor_id, n_votes, reliability, community): expected share of right votes, drawn towards the mean of all contributors by PRIOR_VOTES votes."""
    ship(spark)
    tasks = table(spark, sf_dir, "gold_set")
    m = infer(counted(table(spark, sf_dir, "validation_votes"), tasks), gold_places(tasks))
    right = F.col("p")[F.col("v")]
    seen = m.votes.drop("p", "n_votes").join(m.answers.select("task_id", "p"), "task_id")
    mean = seen.agg(F.avg(right)).first()[0] or 0.0
    per = seen.groupBy("contributor_id").agg(F.count("*").alias("n_votes"), F.sum(right).alias("right")).join(m.contributors, "contributor_id")
    return per.select("contributor_id", "n_votes", ((F.col("right") + PRIOR_VOTES * mean) / (F.col("n_votes") + PRIOR_VOTES)).alias("reliability"), (F.array_position("q", F.array_max("q")) - 1).cast("int").alias("community"))
