import datetime as dt
import random
import uuid

import pytest
from pyspark.sql import functions as F

from fleetspectra.operators.ordering import with_previous
from fleetspectra.operators.signals import clean_signals
from fleetspectra.operators.spectra import spectra
from fleetspectra.spec import Axis, CleanRule, SpectrumSpec
from fleetspectra.streaming.cleaning import clean_stream
from fleetspectra.streaming.tables import BatchTable, start_table

START = dt.datetime(2024, 6, 1)
SCHEMA = "vin string, timestamp timestamp, x double, y long, id int"
RULES = [CleanRule("x", "x > 0", 600), CleanRule("y", "y <> 2", 45, fill=-1), CleanRule("id", "id % 11 <> 3", 0)]
BEFORE = {"id_before": "id", "time_before": "timestamp"}


def at(seconds):
    return START + dt.timedelta(seconds=seconds)


def drive(seed, rows=500):
    """Rows in order of arrival: up to ten minutes late, equal times, missing values, vehicles and times."""
    rng = random.Random(seed)
    clock, out = dict.fromkeys("ABC", 0.0), []
    for i in range(rows):
        vin = rng.choice("AAAABC")
        clock[vin] += rng.choice([0, 0.000001, 0.25, 1, 7, 60, 3600])
        x = rng.choice([None, -1.0, 0.0, 1.5, float("nan"), 3.0])
        out.append((clock[vin] + rng.uniform(0, 600), (vin, at(clock[vin]), x, rng.choice([None, 2, 2**60 + i]), i)))
    for i in range(rows, rows + 20):
        row = rng.choice([(None, at(i), 1.0, 1, i), ("A", None, None, 1, i), (None, None, 2.0, None, i)])
        out.append((i + rng.uniform(0, 600) if row[1] else rng.uniform(0, 50_000), row))
    return [row for _, row in sorted(out, key=lambda r: r[0])]


def arrive(frame, folder, rows, parts):
    """The rows as ``parts`` files, one after the other, and a row far ahead that lets all others through."""
    size = -(-len(rows) // parts)
    for n in range(parts):
        part = rows[n * size : (n + 1) * size]
        random.Random(n).shuffle(part)
        frame(SCHEMA, *part).coalesce(1).write.mode("append").parquet(folder)
    frame(SCHEMA, ("end", at(10**8), 1.0, 1, -1)).coalesce(1).write.mode("append").parquet(folder)


def stream(spark, folder):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)


def run(spark, rows, place, **options):
    table = BatchTable(spark, f"{place}/table")
    query = start_table(rows, table, f"t_{uuid.uuid4().hex}", once=True, checkpoint=f"{place}/checkpoint", **options)
    assert query.awaitTermination(300)
    return table


def as_text(df):
    return sorted(str([str(v) for v in r]) for r in df.where("vin is null or vin <> 'end'").collect())


@pytest.mark.parametrize("drop", [True, False])
def test_clean_stream_gives_the_batch_result(spark, frame, tmp_path, drop):
    rows = drive(4 + drop)
    arrive(frame, f"{tmp_path}/in", rows, 5)
    late = clean_stream(stream(spark, f"{tmp_path}/in"), RULES, BEFORE, {"id_before": -9}, tie=["id"], delay="15 minutes", drop=drop)
    got = run(spark, late, tmp_path).read()
    want = clean_signals(frame(SCHEMA, *rows), RULES, drop, tie=["id"])
    want = with_previous(want, BEFORE, {"id_before": -9}, tie=["id"])
    assert got.columns == want.columns and got.dtypes == want.dtypes
    assert as_text(got) == as_text(want) and (not drop or len(as_text(want)) < len(rows))


def test_rows_behind_the_watermark_are_dropped_and_state_is_forgotten(spark, frame, tmp_path):
    for part in ([("A", at(0), 1.0, 1, 0)], [("B", at(5000), 1.0, 1, 1)], [("B", at(5001), 1.0, 1, 5)], [("A", at(10), 1.0, 1, 2), ("B", at(9000), 1.0, 1, 3)], [("A", at(9001), None, 1, 4)]):
        frame(SCHEMA, *part).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    frame(SCHEMA, ("end", at(10**8), 1.0, 1, -1)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    rules = [CleanRule("x", "x > 0", 10**6)]
    for forget, want in ((None, {0: None, 1: None, 5: 1, 3: 5, 4: 0}), (1000, {0: None, 1: None, 5: 1, 3: 5})):
        found = clean_stream(stream(spark, f"{tmp_path}/in"), rules, {"p": "id"}, delay="10 seconds", forget_s=forget)
        got = run(spark, found, f"{tmp_path}/{forget}").read().where("vin <> 'end'").collect()
        assert {r.id: r.p for r in got} == want  # row 2 came too late; without its state, A's last row has no good reading


def test_a_table_of_batches_is_the_same_after_a_failure(spark, frame, tmp_path):
    """A query that dies after, and one that dies in the middle of, writing a batch go on to the table of one run."""
    arrive(frame, f"{tmp_path}/in", drive(9, 200), 4)
    found = clean_stream(stream(spark, f"{tmp_path}/in"), RULES[:1], BEFORE, tie=["id"], delay="15 minutes")
    want = as_text(run(spark, found, f"{tmp_path}/one").read())
    for fault in ("after", "within"):
        place = f"{tmp_path}/{fault}"
        table = BatchTable(spark, f"{place}/table", snapshot_every=2)

        def dies(rows, batch, table=table, fault=fault):
            if batch != 2:
                return table.write(rows, batch)
            if fault == "after":
                table.write(rows, batch)
            else:  # files of half the rows, without the mark of a finished job
                rows.sample(0.5, seed=1).write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(f"{table.path}/batch=2")
            raise RuntimeError("lost")

        writer = found.writeStream.option("checkpointLocation", f"{place}/checkpoint").trigger(availableNow=True)
        with pytest.raises(Exception, match="lost"):
            writer.foreachBatch(dies).start().awaitTermination(300)
        assert len(table._finished("batch")) == (3 if fault == "after" else 2)
        query = start_table(found, table, f"t_{uuid.uuid4().hex}", once=True, checkpoint=f"{place}/checkpoint")
        assert query.awaitTermination(300)
        assert as_text(table.read()) == want
        table.clean_up()
        assert as_text(table.read()) == want and table._finished("upto")[-1] >= 3


def test_upserts_of_a_growing_spectrum(spark, frame, tmp_path):
    rows = [(vin, at(t), x, y, i) for vin, t, x, y, i in ((r[0], n, r[2], r[3], n) for n, r in enumerate(drive(2, 120)))]
    arrive(frame, f"{tmp_path}/in", rows, 3)
    spec = SpectrumSpec("x", (Axis("x", 0, 4, 1),))
    keys = ["ls_config_id", "vin", "x1_quantized"]
    seen = {}
    for every in (0, 2):
        table = BatchTable(spark, f"{tmp_path}/{every}/table", keys, every)
        counted = spectra(stream(spark, f"{tmp_path}/in"), [spec], ["time"])
        query = start_table(counted, table, f"t_{uuid.uuid4().hex}", "update", once=True, checkpoint=f"{tmp_path}/{every}/checkpoint")
        assert query.awaitTermination(300)
        last = max(table._finished("batch"))
        batch = spark.read.parquet(f"{table.path}/batch={last}")
        again = spark.createDataFrame(batch.collect(), batch.schema)
        table.write(again, last)  # a batch that is written again changes nothing
        seen[every] = as_text(table.read())
    assert seen[0] == seen[2] == as_text(spectra(frame(SCHEMA, *rows), [spec], ["time"]))


def test_a_table_without_a_batch_is_named(spark, tmp_path):
    with pytest.raises(ValueError, match="no finished batch"):
        BatchTable(spark, f"{tmp_path}/none").read()


def test_arrivals_are_one_file_each_whatever_the_table_is_cut_into(spark, tmp_path):
    from pathlib import Path

    from registry import queries

    rows = spark.range(600, numPartitions=8).selectExpr(
        "id AS event_id", "timestamp_ntz'2024-06-01 00:00:00' + make_dt_interval(0, 0, 0, id * 60) AS ts", "id % 7 AS user_id",
        "'view' AS event_type", "CAST(id AS DOUBLE) AS value", "'' AS props",
    )
    rows.write.parquet(f"{tmp_path}/events.parquet")
    place = Path(queries.shared_folder(spark).removeprefix("file:"))
    before = set(place.glob("arrivals-*"))
    queries._arriving(spark, str(tmp_path))
    (folder,) = set(place.glob("arrivals-*")) - before
    assert len(list(folder.glob("*.parquet"))) <= queries.ARRIVALS + 2  # the far row may bring an empty file
    assert spark.read.parquet(str(folder)).where("vin <> -1").count() == 600
