"""Every query of the core against its SQL, on the driver's tables."""

from __future__ import annotations

import datetime
import math
from pathlib import Path

import duckdb
import pytest

from cadenza.plans import accounts, directory, files, keyboard, queue, ranges, schedule, score, telemetry

DATA = "/root/testdata/sf0.001"
MODULES = (score, queue, accounts, telemetry, schedule, keyboard, directory, files, ranges)
NAMES = [(m, k) for m in MODULES for k in m.QUERIES]
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in Path(DATA).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.6f}"
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, bool) or v is None:
        return str(v)
    return f"{float(v):.6f}" if isinstance(v, int) else str(v)


@pytest.mark.parametrize(("module", "name"), NAMES, ids=[k for _, k in NAMES])
def test_query(spark, duck, module, name):
    df = module.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    rows = sorted(tuple(map(plain, r)) for r in df.select(*columns).collect())
    assert rows or name in ()
    if name not in module.SQL:
        return
    found = duck.execute(module.SQL[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    assert rows == sorted(tuple(plain(r[i]) for i in order) for r in found.fetchall())


def test_whole_jobs(spark):
    """The queries beside the ones that take a part: every note, message and beat comes back."""
    notes, ad = score.ad.timed(spark, DATA), score.ad
    assert score.QUERIES["q350_sorted_notes"](spark, DATA).count() == notes.count()
    assert queue.QUERIES["q307_payload_of_every_message"](spark, DATA).count() == ad.table(spark, DATA, "orders").count()
    assert sum(r["beats"] for r in score.QUERIES["q504_beats_of_whole_scores"](spark, DATA).collect()) == score.pb.beats(ad.starts(spark, DATA), 4).count()
    outside = notes.join(score.QUERIES["q324_keyboard_range_of_all_notes"](spark, DATA), "doc").where("pitch < low or pitch > high")
    assert outside.isEmpty()


def test_tasks_grow_with_the_lines(spark, monkeypatch):
    """No task sorts more lines the larger the table is, whatever the session's number of partitions."""
    monkeypatch.setattr(score.ad, "LINES", 100)
    n = score.ad.tasks(spark, DATA)
    assert n >= score.ad.table(spark, DATA, "lineitem").count() / 100 > 8
    for name in ("q344_beam_groups", "q304_next_onset", "q343_last_before_playhead", "q320_min_width"):
        assert "hashpartitioning(doc#" in (plan := score.QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()) and f", {n})" in plan


def exchanges(df):
    return [line for line in df._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hashpartitioning" in line or "MapInArrow" in line]


def test_probes_are_dealt_out_by_size(spark, monkeypatch):
    """Questions sort the lines in as many tasks as the notes do."""
    monkeypatch.setattr(score.ad, "LINES", 100)
    n = score.ad.tasks(spark, DATA)
    lines = [x for x in exchanges(score.ad.probes(spark, DATA)) if "orderkey#" in x]
    assert len(lines) == 2 and all(f", {n})" in x for x in lines)


def test_key_sets_are_dealt_out_by_size(spark, monkeypatch):
    """The keys of all questions are gathered and joined in as many tasks as the notes are sorted in."""
    monkeypatch.setattr(score.ad, "LINES", 100)
    n = score.ad.tasks(spark, DATA)
    for name in ("q317_expected_keys_over_whole_scores", "q301_sounding_at_over_whole_scores", "q320_min_width", "q304_next_onset_over_whole_scores", "q344_beam_groups"):
        found = exchanges(score.QUERIES[name](spark, DATA))
        assert found and all(f", {n})" in x for x in found)


def test_folds_of_measures_are_dealt_out_by_size(spark, monkeypatch):
    """Measures are packed in as many tasks as the notes are sorted in."""
    monkeypatch.setattr(score.ad, "LINES", 100)
    n = score.ad.tasks(spark, DATA)
    for module, name in ((score, "q203_systems"), (score, "q334_justified_measures"), (ranges, "q203_systems_by_ranges"), (keyboard, "q515_next_lines")):
        found = exchanges(module.QUERIES[name](spark, DATA))
        below = [b for a, b in zip(found, found[1:]) if "MapInArrow" in a]
        assert below and all(f", {n})" in x for x in below)
