"""Cards of all scopes from the bursts of timeline days, folders and tag sets."""
from __future__ import annotations

import random

from silvergrain.operators import heroes, scopes, sessions
from silvergrain.plans.heroes import SCOPE

ROW = ("sha1 string, final_dt string, ts long, hero_score double, has_gps boolean, latitude double, longitude double, lat3 double, "
       "lon3 double, undated int, decade string, year string, date_key string, folder_group string, web_path string, tags array<string>")


def photos(n: int = 400) -> list[tuple]:
    """Bursts around a midnight in nested folders; some without place, time or both, some in no folder."""
    rng, rows = random.Random(5), []
    for i in range(n):
        second, gps, timed = rng.randrange(-900, 900), rng.random() < 0.9, rng.random() < 0.9
        day = "1999-12-31" if second < 0 else "2000-01-01"
        lat = rng.randrange(30) / 1000 if gps else None
        when = (day[:3] + "0s", day[:4], day) if timed else (None, None, None)
        rows.append((f"{i:04}", f"{second:05}" if timed else "", 946684800 + second if timed else None, rng.randrange(9) / 9, gps,
                     lat, lat, lat, lat, int(not timed), *when, None if timed else "Root",
                     rng.choice(("a/b/x.jpg", "a/x.jpg", "/x.jpg", "x.jpg")), rng.sample(["t", "u", "v"], rng.randrange(3))))
    return rows


def test_cards_from_leaves_are_those_of_all_members(spark):
    rows = spark.createDataFrame(photos(), ROW)
    got, want = (sorted(map(tuple, cards.collect())) for cards in (
        heroes.scope_selection(rows), heroes.hero_selection(scopes.membership(rows), SCOPE)))
    assert got == want and len(got) > 100


def test_scopes_meet_pieces_of_bursts(spark):
    """A burst goes to its day, month, year, decade and folders as one piece, however many photos it has."""
    burst = [(f"{i:04}", f"{i:05}", 946684800 + 3 * i, 0.5, True, 1.0, 1.0, 1.0, 1.0, 0, "2000s", "2000", "2000-01-01", None,
              "a/b/c/x.jpg", ["t"]) for i in range(300)]
    rows = scopes.leaf_rows(spark.createDataFrame(burst, ROW))
    pieces = sessions.day_pieces(rows, [*scopes.LEAF, "lat3", "lon3"], 15)
    assert rows.count() == 900 and pieces.count() == 3 and scopes.membership(pieces).count() == 8
