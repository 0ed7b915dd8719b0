"""The per-group part of the rating fold, run by the workers.

Workers get this module by value (see fold.py), so it imports nothing of the package. Only the
dependent steps run row by row; everything else is done on whole Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_US = pa.timestamp("us", tz="UTC")
_STATE_TYPE = pa.struct([
    ("rating", pa.float64()), ("seq", pa.int64()), ("break_no", pa.int32()), ("mean", pa.float64()),
    ("wins", pa.int64()), ("draws", pa.int64()), ("losses", pa.int64()), ("last_date", pa.string()),
    ("first_ts", _US), ("first_src_rank", pa.int32()), ("first_ord", pa.int64()),
    ("first_side", pa.int32()),
])
_FIRST_FIELDS = ("first_ts", "first_src_rank", "first_ord", "first_side")
_EVENT_TYPES = [
    ("team", pa.string()), ("event", pa.string()), ("seq", pa.int64()), ("date", pa.string()),
    ("match_id", pa.int64()), ("side", pa.int32()), ("ts", _US), ("src_rank", pa.int32()),
    ("ord", pa.int64()), ("rating_before", pa.float64()), ("rating_after", pa.float64()),
    ("state", _STATE_TYPE),
]


def _events(n: int, **columns) -> pa.RecordBatch:
    arrays = [columns[name] if name in columns else pa.nulls(n, kind) for name, kind in _EVENT_TYPES]
    return pa.RecordBatch.from_arrays(arrays, names=[name for name, _ in _EVENT_TYPES])


def _constant(text: str, n: int) -> pa.Array:
    return pa.repeat(pa.scalar(text, pa.string()), n)


def _floats(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False)


class _Teams:
    """Records of the teams seen so far, one list per field, addressed by a small number."""

    def __init__(self):
        self.number: dict[str, int] = {}
        self.name: list[str] = []
        self.rating: list = []      # None until the team first plays
        self.seq: list[int] = []
        self.break_no: list[int] = []
        self.mean: list = []        # None while no league is known
        self.last_date: list = []
        self.first: list = []
        self.score = np.zeros((0, 3), np.int64)   # wins, draws, losses

    def numbers(self, column: pa.Array) -> np.ndarray:
        """Numbers of the names in `column`; new names are added."""
        coded = column.dictionary_encode()
        known = []
        for name in coded.dictionary.to_pylist():
            at = self.number.get(name)
            if at is None:
                at = self.number[name] = len(self.name)
                self.name.append(name)
                self.rating.append(None)
                self.seq.append(0)
                self.break_no.append(0)
                self.mean.append(None)
                self.last_date.append(None)
                self.first.append(None)
            known.append(at)
        missing = len(self.name) - len(self.score)
        if missing:
            self.score = np.concatenate([self.score, np.zeros((missing, 3), np.int64)])
        return np.asarray(known, np.int64)[coded.indices.to_numpy(zero_copy_only=False)]

    def restore(self, names: pa.Array, states: list[dict]) -> None:
        for at, state in zip(self.numbers(names).tolist(), states):
            self.rating[at], self.seq[at] = state["rating"], state["seq"]
            self.break_no[at], self.mean[at] = state["break_no"], state["mean"]
            self.last_date[at] = state["last_date"]
            self.first[at] = tuple(state[f] for f in _FIRST_FIELDS)
            self.score[at] = state["wins"], state["draws"], state["losses"]

    def count_results(self, home: np.ndarray, away: np.ndarray, actual: np.ndarray) -> None:
        n = len(self.name)
        for value, for_home, for_away in ((1.0, 0, 2), (0.5, 1, 1), (0.0, 2, 0)):
            hit = actual == value
            self.score[:, for_home] += np.bincount(home[hit], minlength=n)
            self.score[:, for_away] += np.bincount(away[hit], minlength=n)

    def note_dates(self, home: np.ndarray, away: np.ndarray, dates: pa.Array) -> None:
        """Keep the date of each team's last row of the batch."""
        row = np.full(len(self.name), -1, np.int64)
        np.maximum.at(row, home, np.arange(len(home)))
        np.maximum.at(row, away, np.arange(len(away)))
        played = np.flatnonzero(row >= 0)
        for at, date in zip(played.tolist(), dates.take(pa.array(row[played])).to_pylist()):
            self.last_date[at] = date

    def regress(self, at: int, target: int, breaks: dict, factor: float, initial: float, out: list) -> None:
        """Apply the breaks after the team's last one up to `target`; one event each goes to `out`."""
        mean = initial if self.mean[at] is None else self.mean[at]
        for number in range(self.break_no[at] + 1, target + 1):
            before = self.rating[at]
            self.rating[at] = after = before + factor * (mean - before)
            self.seq[at] += 1
            day, ts = breaks[number]
            out.append((self.name[at], self.seq[at], day, ts, before, after))
        self.break_no[at] = target

    def states(self) -> pa.RecordBatch:
        n = len(self.name)
        first = list(zip(*self.first))
        rating, seq = pa.array(self.rating, pa.float64()), pa.array(self.seq, pa.int64())
        fields = [
            rating, seq, pa.array(self.break_no, pa.int32()), pa.array(self.mean, pa.float64()),
            *[pa.array(self.score[:n, i]) for i in range(3)], pa.array(self.last_date, pa.string()),
            *[pa.array(first[i], _STATE_TYPE.field(name).type) for i, name in enumerate(_FIRST_FIELDS)],
        ]
        return _events(
            n, team=pa.array(self.name, pa.string()), event=_constant("state", n), seq=seq, rating_after=rating,
            state=pa.StructArray.from_arrays(fields, fields=list(_STATE_TYPE)))


def _regress_batch(rows: list) -> pa.RecordBatch:
    team, seq, day, ts, before, after = zip(*rows)
    return _events(
        len(rows), team=pa.array(team), event=_constant("regress", len(rows)),
        seq=pa.array(seq, pa.int64()), date=pa.array(day, pa.string()), ts=pa.array(ts, _US),
        rating_before=pa.array(before, pa.float64()), rating_after=pa.array(after, pa.float64()))


def _twice(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a and b alternating: home and away of each match."""
    out = np.empty(2 * len(a), a.dtype)
    out[0::2], out[1::2] = a, b
    return out


def folder(home_advantage: float, initial: float, factor: float, breaks: dict, closing: bool,
           with_events: bool):
    """The grouped-map function; `breaks` maps a break number to (day, instant).

    Rows with a `state` bring in a team's record from earlier rows and come first; `closing` applies
    the breaks after the last row.
    """
    last_break = max(breaks, default=0)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        teams = _Teams()
        for batch in batches:
            col = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
            if "state" in col and col["state"].null_count < len(batch):
                carried = col["state"].is_valid()
                teams.restore(col["home"].filter(carried), col["state"].filter(carried).to_pylist())
                batch = batch.filter(col["state"].is_null())
                col = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
            n = len(batch)
            if n == 0:
                continue
            home, away = teams.numbers(col["home"]), teams.numbers(col["away"])
            actual, step = _floats(col["actual"]), _floats(col["step"])
            base = {0: col["home_base"], 1: col["away_base"]}
            first_key = [col["ts"], col["src_rank"], col["ord"]]
            rating, seq, break_no, mean = teams.rating, teams.seq, teams.break_no, teams.mean
            # leagues are looked at again only while some team or row lacks one
            leagueless = any(c.null_count for c in base.values()) or any(
                m is None and r is not None for m, r in zip(mean, rating))
            old_h, old_a, new_h, new_a = [0.0] * n, [0.0] * n, [0.0] * n, [0.0] * n
            seq_h, seq_a = [0] * n, [0] * n
            regressed: list = []

            def enter(at: int, row: int, side: int, now: int) -> None:
                """A team's first match, or one before which breaks or a league are still to be noted."""
                own = base[side][row].as_py()
                if rating[at] is None:
                    rating[at] = initial if own is None else own
                    break_no[at], mean[at] = now, own
                    teams.first[at] = (*[c[row].as_py() for c in first_key], side)
                    return
                if break_no[at] < now:
                    teams.regress(at, now, breaks, factor, initial, regressed)
                if mean[at] is None:
                    mean[at] = own

            rows = zip(range(n), home.tolist(), away.tolist(), actual.tolist(), step.tolist(),
                       col["break_no"].to_pylist())
            for i, h, a, score, k, now in rows:
                if leagueless or rating[h] is None or break_no[h] < now:
                    enter(h, i, 0, now)
                if leagueless or rating[a] is None or break_no[a] < now:
                    enter(a, i, 1, now)
                rh, ra = rating[h], rating[a]
                expected = 1.0 / (1.0 + 10.0 ** ((ra - rh - home_advantage) / 400.0))
                old_h[i], old_a[i] = rh, ra
                rating[h] = new_h[i] = rh + k * (score - expected)
                rating[a] = new_a[i] = ra + k * ((1.0 - score) - (1.0 - expected))
                seq[h] = seq_h[i] = seq[h] + 1
                seq[a] = seq_a[i] = seq[a] + 1

            teams.count_results(home, away, actual)
            teams.note_dates(home, away, col["date"])
            if with_events:
                rows_twice = np.repeat(np.arange(n), 2)
                twice = pa.array(rows_twice)
                after_h = np.where(home == away, new_a, new_h)
                yield _events(
                    2 * n, team=pa.array(teams.name, pa.string()).take(pa.array(_twice(home, away))),
                    event=_constant("match", 2 * n), seq=pa.array(_twice(np.array(seq_h), np.array(seq_a))),
                    date=col["date"].take(twice), match_id=col["id"].take(twice),
                    side=pa.array(np.tile(np.array([0, 1], np.int32), n)), ts=col["ts"].take(twice),
                    src_rank=col["src_rank"].take(twice), ord=col["ord"].take(twice),
                    rating_before=pa.array(_twice(np.array(old_h), np.array(old_a))),
                    rating_after=pa.array(_twice(after_h, np.array(new_a))))
                if regressed:
                    yield _regress_batch(regressed)
        if closing:
            regressed = []
            for at in range(len(teams.name)):
                if teams.break_no[at] < last_break:
                    teams.regress(at, last_break, breaks, factor, initial, regressed)
            if with_events and regressed:
                yield _regress_batch(regressed)
        if teams.name:
            yield teams.states()

    return fold
