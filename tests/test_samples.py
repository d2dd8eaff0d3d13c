"""Endless streams, batches by worker, whole parts, and patches with state across batches and restarts."""

from collections import Counter

import pytest

from lumaquery.streaming import samples


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([(f"i{k}", k) for k in range(10)], "image_name string, v int")


def test_steps_share_no_divisor():
    assert samples.steps(10, 3, 4) == [3, 7, 11, 13] and all(21 % x for x in samples.steps(21, 3, 3))


def test_drawn(spark, rows):
    out = samples.drawn(spark.range(35), "id", rows, "image_name", 4, workers=2).collect()
    assert len(out) == 35
    by = [sorted(r.image_name for r in out if r.epoch == e) for e in range(4)]
    assert by[0] == by[1] == by[2] == sorted(f"i{k}" for k in range(10)) and len(set(by[3])) == 5
    orders = {tuple(r.image_name for r in sorted(out, key=lambda r: (r.batch, r.slot)) if r.epoch == e) for e in range(3)}
    assert len(orders) == 3
    assert all(r.worker == r.slot // 2 for r in out) and Counter(r.batch for r in out)[0] == 4
    with pytest.raises(ValueError, match="no rows"):
        samples.drawn(spark.range(1), "id", rows.where("false"), "image_name", 4)


def run(frame, path, batches):
    """Runs the stream for at least so many batches, and stops it."""
    query = frame.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").start()
    while query.isActive and (query.lastProgress is None or query.lastProgress["batchId"] < batches):
        query.awaitTermination(0.2)
    query.stop()
    query.awaitTermination(20)


def test_endless_stream_goes_on_after_a_restart(spark, rows, tmp_path):
    make = lambda: samples.endless(spark, rows, "image_name", 4, workers=2, rows_per_batch=7)
    run(make(), tmp_path, 1)
    before = spark.read.parquet(f"{tmp_path}/out").count()
    run(make(), tmp_path, 4)
    out = spark.read.parquet(f"{tmp_path}/out").collect()
    n = len(out)
    assert 7 <= before < n and n % 7 == 0
    assert sorted(map(tuple, out)) == sorted(map(tuple, samples.drawn(spark.range(n), "id", rows, "image_name", 4, 2).collect()))


def test_worker_batches(spark, rows):
    out = samples.worker_batches(rows, 4, 2).collect()
    assert sorted(r.image_name for r in out) == sorted(f"i{k}" for k in range(10))
    assert Counter((r.worker, r.batch) for r in out) == {(w, b): 2 if b < 2 else 1 for w in (0, 1) for b in range(3)}
    assert all(r.partly_filled == (r.batch == 2) and r.slot // 2 == r.worker for r in out)


def test_whole_parts(spark):
    cells = spark.createDataFrame([("a", k) for k in range(11)] + [("b", k) for k in range(3)], "image string, cell int")
    out = samples.whole_parts(cells, "image", ["cell"], 4).collect()
    assert Counter((r.image, r.part) for r in out) == {("a", 0): 4, ("a", 1): 4} and len({r.cell for r in out}) == 8


def grid(spark, relevant, side=128):
    return samples.packed_cells(spark.createDataFrame([(i, r, c, side, side) for i, r, c in relevant], "image string, row int, col int, height int, width int"), "image")


def test_patches_hold_every_cell_once_drawn(spark):
    # fixed values: three far cells need three patches, one in a corner is moved inside
    three = samples.all_patches(grid(spark, [("a", 0, 0), ("a", 50, 50), ("a", 0, 127)]), "image", 32, 32).collect()
    assert sorted((r.top, r.left) for r in three) == [(0, 0), (0, 96), (34, 34)]
    full = grid(spark, [("a", r, c) for r in range(64) for c in range(64)], 64)
    out = samples.all_patches(full, "image", 32, 32).collect()
    held = {(r, c) for p in out for r in range(p.top, p.top + 32) for c in range(p.left, p.left + 32)}
    assert len(held) == 64 * 64 and len(out) >= 4
    assert samples.all_patches(full, "image", 32, 32, most=2).count() == 2


def test_stateful_patches_over_batches_and_restarts(spark, tmp_path):
    samples.use_rocksdb(spark)
    packed = grid(spark, [(i, r, c) for i in "ab" for r in range(48) for c in range(48)], 48)
    every = sorted(map(tuple, samples.all_patches(packed, "image", 16, 16).collect()))
    source = f"{tmp_path}/in"

    def ask(*wanted):
        spark.createDataFrame(list(wanted), "image string, patches int").coalesce(1).write.mode("append").parquet(source)

    def work():
        stream = spark.readStream.schema("image string, patches int").option("maxFilesPerTrigger", 1).parquet(source)
        out = samples.stateful_patches(stream, packed, "image", 16, 16)
        query = out.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
        query.awaitTermination(300)
        assert query.exception() is None
        return sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").collect()))

    ask(("a", 2), ("b", 1), ("a", 1))
    first = work()
    assert first == [x for x in every if x[1] < (3 if x[0] == "a" else 1)]
    ask(("a", 1000))
    ask(("b", 2))
    second = work()
    assert second == [x for x in every if x[0] == "a" or x[1] < 3]  # goes on where it was, nothing twice
    ask(("a", 5))
    assert work() == second  # no free cells are left
