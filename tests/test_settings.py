"""Settings in force at samples against a plain search, and the size of the join."""

import random
from datetime import datetime, timedelta

from counterlake.operators import settings

START = datetime(2024, 1, 1)


def _tables(spark, seed):
    rng = random.Random(seed)
    at = lambda: START + timedelta(seconds=rng.randrange(0, 9 * 86_400))
    log = {(s, 1, f"n{k}", at()) for s in (1, 2, 3) for k in range(4) for _ in range(rng.randrange(0, 5))}
    log |= {(2, 1, "pg_stat_statements.max", START)}
    samples = [(s, t, START + timedelta(hours=7 * t)) for s in (1, 2, 4) for t in range(25)]
    rows = [(*k, f"v{n}", f"v{n}", "b", None, None, None, False) for n, k in enumerate(sorted(log, key=str))]
    return spark.createDataFrame(rows, "server_id int, setting_scope int, name string, first_seen timestamp, setting string, reset_val "
                                 "string, boot_val string, unit string, sourcefile string, sourceline int, pending_restart boolean"), \
        spark.createDataFrame(samples, "server_id int, sample_id int, sample_time timestamp"), rows, samples


def test_settings_at_samples_equal_a_plain_search(spark):
    log, samples, rows, ticks = _tables(spark, 3)
    for seconds in (3_600, 86_400, 40 * 86_400):
        got = settings.settings_at_samples(log, samples, bin_seconds=seconds).collect()
        want = []
        for s, t, time in ticks:
            for name in {r[2] for r in rows if r[0] == s}:
                seen = [r for r in rows if r[0] == s and r[2] == name and r[3] <= time]
                if seen:
                    want.append((s, t, name, max(seen, key=lambda r: r[3])[4]))
        assert sorted((r.server_id, r.sample_id, r.name, r.setting) for r in got) == sorted(want)


def test_ranges_meet_samples_of_their_bin_only(spark):
    log, samples, _, _ = _tables(spark, 5)
    found = settings.settings_at_samples(log, samples)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join Inner" in line]
    assert any("_bin" in line for line in joins) and "Cartesian" not in found._jdf.queryExecution().executedPlan().toString()
    wide = spark.createDataFrame([(9, 1, "x", START + timedelta(days=d)) for d in range(200)],
                                 "server_id int, setting_scope int, name string, first_seen timestamp")
    for c in settings.STORED:
        wide = wide.selectExpr("*", f"CAST(NULL AS STRING) AS {c}")
    ticks = spark.createDataFrame([(9, d, START + timedelta(days=d, hours=1)) for d in range(200)],
                                  "server_id int, sample_id int, sample_time timestamp")
    # 200 versions and 200 samples: a bin holds a sample and two versions, not 200
    ranges = settings.validity(wide)
    met = ticks.alias("t").join(ranges.alias("r"), "server_id").filter(
        "to_date(t.sample_time) BETWEEN to_date(r.first_seen) AND to_date(coalesce(r.next_seen, t.sample_time))").count()
    assert met <= 2 * 200 + 1 and settings.settings_at_samples(wide, ticks).count() == 200
