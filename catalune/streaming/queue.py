"""The play queue as a state machine over an event stream; batch and stream share its step.

A state holds the song that plays, what the user queued, the rest of the list that play began from, that list, and
what was played. Every action is a function of such a state that gives the parts it changes.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalune.operators.folds import ordered_fold

KEEP = 200  #: played songs that are remembered
EMPTY: dict = {"current": None, "next": [], "rest": [], "source": [], "played": []}


def _without(xs: list, gone: Iterable) -> list:
    gone = set(gone)
    return [x for x in xs if x not in gone]


def _put(xs: list, new: list, at: int) -> list:
    """new at a place of xs, taken from wherever they were in it."""
    new = list(dict.fromkeys(new))
    return _without(xs[:at], new) + new + _without(xs[at:], new)


def _mixed(xs: list, seed: int) -> list:
    """A seeded order, by the generator's numbers."""
    from catalune.operators.making import Numbers

    out, draw = list(xs), Numbers(seed)
    for i in reversed(range(1, len(out))):
        j = int(draw() * (i + 1))
        out[i], out[j] = out[j], out[i]
    return out


def _now(q: dict, song) -> dict:
    """song plays; what played before is remembered."""
    return {"current": song, "played": q["played"] if q["current"] is None else [*q["played"], q["current"]][-KEEP:]}


def start(q: dict, song, songs=(), shuffle=None, **_) -> dict:
    """Play a song of a list: the list goes on behind it, or in a seeded order with ``shuffle``; what is queued stays."""
    queued, songs = _without(q["next"], [song]), list(songs)
    rest = _mixed(_without(songs, [song]), shuffle) if shuffle is not None else songs[songs.index(song) + 1 :] if song in songs else songs
    past = {"current": song} if q["current"] == song else _now(q, song)
    return past | {"next": queued, "rest": _without(rest, queued), "source": songs}


def advance(q: dict, song=None, repeat=False, shuffle=None, playable=None, **_) -> dict:
    """The next song that can be played: a queued one, else the list's; with ``repeat`` the list begins again, once."""
    again = (_mixed(q["source"], shuffle) if shuffle is not None else list(q["source"])) if repeat else []
    line = [("next", x) for x in q["next"]] + [("rest", x) for x in q["rest"]] + [("again", x) for x in again]
    at = next((i for i, (_, x) in enumerate(line) if playable is None or x in playable), None)
    if at is None:
        return _now(q, None) | {"next": [], "rest": []}
    left = line[at + 1 :]
    rest = [x for part, x in left if part == ("again" if line[at][0] == "again" else "rest")]
    return _now(q, line[at][1]) | {"next": [x for part, x in left if part == "next"], "rest": rest}


def back(q: dict, song=None, **_) -> dict:
    """The song before; the one that plays goes to the front of the list's rest."""
    if not q["played"]:
        return {}
    return {"current": q["played"][-1], "played": q["played"][:-1], "rest": q["rest"] if q["current"] is None else [q["current"], *q["rest"]]}


def place(q: dict, song=None, songs=(), at=None, part="next", **_) -> dict:
    """Songs to a place of the queue (the end without ``at``) or of the rest; they leave where they were."""
    new, other = list(songs) or [song], "rest" if part == "next" else "next"
    return {part: _put(q[part], new, len(q[part]) if at is None else at), other: _without(q[other], new)}


def jump(q: dict, song=None, at=0, part="next", **_) -> dict:
    """Play a song of the queue now; in the rest, those before it are passed over."""
    if not 0 <= at < len(q[part]):
        return {}
    return _now(q, q[part][at]) | {part: q[part][at + 1 :] if part == "rest" else q[part][:at] + q[part][at + 1 :]}


def drop(q: dict, song=None, **_) -> dict:
    return {"next": _without(q["next"], [song]), "rest": _without(q["rest"], [song]), "current": None if q["current"] == song else q["current"]}


def clear(q: dict, song=None, part="next", **_) -> dict:
    return {part: []}


def reshuffle(q: dict, song=None, shuffle=None, **_) -> dict:
    """The rest in a seeded order; without ``shuffle`` the list's order again, from the song that plays."""
    if shuffle is not None:
        return {"rest": _mixed(q["rest"], shuffle)}
    src, known = q["source"], q["current"] in q["source"]
    rest = src[src.index(q["current"]) + 1 :] if known else [x for x in src if x in set(q["rest"])]
    return {"rest": _without(rest, [*q["next"], q["current"]])}


def prune(q: dict, song=None, songs=(), **_) -> dict:
    """Only songs that are still there stay."""
    there = set(songs)
    return {k: [x for x in v if x in there] if isinstance(v, list) else v if v in there else None for k, v in q.items()}


MOVES = {
    "start": start, "play": lambda q, song, **how: start(q, song, q["source"], **{k: v for k, v in how.items() if k != "songs"}) if song in q["source"] else _now(q, song) | {"next": _without(q["next"], [song]), "rest": _without(q["rest"], [song])},
    "add": place, "top": lambda q, song=None, **how: place(q, song, **how | {"at": 0}), "later": lambda q, song=None, **how: place(q, song, **how | {"part": "rest"}),
    "advance": advance, "back": back, "jump": jump, "drop": drop, "clear": clear, "reshuffle": reshuffle, "prune": prune,
}


def step(q: dict, action: str, song=None, **how) -> dict:
    """The state after an action; see the functions above for what each takes."""
    return q | MOVES[action](q, song, **how)


ACTIONS = {"purchase": "start", "click": "add", "view": "top", "login": "advance", "logout": "back", "error": "drop"}


def _row(q: dict) -> dict:
    return {"current": q["current"], "waiting": len(q["next"]) + len(q["rest"]), "played": len(q["played"])}


def replay(events: DataFrame, key: str, order: str, kind: str, song: str, songs: str | None = None) -> DataFrame:
    """(key, current, waiting, played) after all of a key's events, in order; ``songs`` is a column of lists to start
    from. A key's state is all that is kept."""
    actions = F.create_map(*(F.lit(x) for kv in ACTIONS.items() for x in kv))
    d = events.select(F.col(key).alias("k"), F.col(order).alias("o"), F.coalesce(actions[F.col(kind)], F.lit("advance")).alias("a"), F.col(song).cast("long").alias("s"), (F.col(songs) if songs else F.array().cast("array<long>")).alias("l"))

    def one(q, action, s, lists):
        q = step(q, action, None if s is None else int(s), songs=[int(x) for x in lists] if lists is not None and action == "start" else ())
        return q, tuple(_row(q).values())

    return ordered_fold(d.withColumn("l", F.to_json("l")), "k", "o", ["a", "s", "l"], EMPTY, lambda q, a, s, j: one(q, a, s, json.loads(j) if j else None), "current long, waiting long, played long", last=True).withColumnRenamed("k", key)


def live(events: DataFrame, key: str, order: str, kind: str, song: str) -> DataFrame:
    """The same over a stream: a row after each batch of a key's events, which are put in order first."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def run(k, parts: Iterator[pd.DataFrame], state: GroupState):
        q = json.loads(state.get[0]) if state.exists else EMPTY
        pdf = pd.concat(list(parts))
        for r in pdf.sort_values(["o", "a", "s"], kind="stable").itertuples(index=False):
            q = step(q, ACTIONS.get(r.a, "advance"), int(r.s))
        state.update((json.dumps(q),))
        yield pd.DataFrame([{"k": k[0], "current": q["current"], "waiting": _row(q)["waiting"]}])

    d = events.select(F.col(key).alias("k"), F.col(order).alias("o"), F.col(kind).alias("a"), F.col(song).alias("s"))
    kt = events.schema[key].dataType.simpleString()
    return d.groupBy("k").applyInPandasWithState(run, f"k {kt}, current long, waiting long", "q string", "update", GroupStateTimeout.NoTimeout)
