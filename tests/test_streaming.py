"""Host ranges, expiring lookups and background scans, streamed against batch and by hand."""

import random

from kinegrain.streaming import host, scan

SCHEMA = "instance string, seq bigint, time double, source_frame bigint, source string, first double, last double"


def renders(seed=2):
    r, rows = random.Random(seed), []
    for i in range(12):
        source, offset, first = "a", r.choice([0, -3, 10]), float(r.randint(0, 20))
        for seq in range(15):
            if r.random() < 0.1:
                source = r.choice("abc")
            if r.random() < 0.06:
                offset += r.choice([1, -2])
            t = first + r.randint(-3, 12)
            known = r.random() < 0.8
            rows.append((f"i{i}", seq, t, int(t + offset), source, first if known else None, first + r.randint(0, 9) if known else None))
    return rows


def by_hand(rows):
    out, state = {}, {}
    for inst, seq, t, frame, source, a, b in rows:
        last_source, last, retimed = state.get(inst, (None, None, False))
        offset = frame - t
        if source != last_source:
            last, retimed = None, False
        retimed = retimed or last is not None and abs(offset - last) > 0.01
        state[inst] = (source, offset, retimed)
        known = a is not None and b > a and a - 0.5 <= t <= b + 0.5
        lo, hi = (round(a + offset), round(b + offset)) if known else (0, -1)
        good = known and not retimed and hi >= 0 and hi >= lo
        out[inst, seq] = (retimed, max(lo, 0) if good else 0, hi if good else None)
    return out


def test_host_ranges(spark, tmp_path):
    rows = renders()
    want = by_hand(rows)
    frame = spark.createDataFrame(rows, SCHEMA)
    seen = lambda got: {(g.instance, g.seq): (g.retimed, g.used_first, g.used_last) for g in got}
    batch = host.host_ranges(frame).collect()
    assert seen(batch) == want and any(v[0] for v in want.values()) and any(v[2] for v in want.values())
    notes = {g.note.split(" ")[1] for g in batch}
    assert notes == {"the", "host"}
    for k in range(0, 15, 5):
        spark.createDataFrame([r for r in rows if k <= r[1] < k + 5], SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    work = scan.Scan(host.stream_ranges(stream), "ranges_out", f"{tmp_path}/cp", total=len(rows))
    assert work.wait(120) and work.done == len(rows) and work.percent == 100.0
    streamed = spark.table("ranges_out").collect()
    assert seen(streamed) == want and sorted(g.note for g in streamed) == sorted(g.note for g in batch)
    work.cancel()
    assert host.host_ranges(frame.limit(0)).count() == 0


def test_expiring_lookups(spark):
    r = random.Random(1)
    rows = [(k, round(r.uniform(0, 200), 1), r.random() < 0.02) for k in "abcd" for _ in range(60)] + [("e", 1.0, None), ("e", None, True), (None, 3.0, False)]
    got = host.expiring_lookups(spark.createDataFrame(rows, "key string, at double, found boolean")).collect()
    want = []
    for k in [*"abcde", None]:
        until = None
        for at, found in sorted(((t, bool(f)) for key, t, f in rows if key == k and t is not None), key=lambda x: (x[0], not x[1])):
            again = until is None or at > until
            if again:
                until = float("inf") if found else at + 20
            want.append((k, at, found, again))
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_cancelled_scan_goes_on(spark, tmp_path):
    schema = "id bigint"
    for k in range(6):
        spark.range(k * 10, k * 10 + 10).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    out = f"{tmp_path}/out"
    first = scan.Scan(stream(), "scan_one", f"{tmp_path}/cp", total=60, sink="parquet", path=out)
    first.cancel()
    assert not first.query.isActive and first.percent <= 100.0
    second = scan.Scan(stream(), "scan_two", f"{tmp_path}/cp", sink="parquet", path=out)
    assert second.wait(120) and second.percent is None
    assert sorted(r.id for r in spark.read.schema(schema).parquet(out).collect()) == list(range(60))
