import os

from pyspark.sql import functions as F

from choicelens.plans.registrations import RAW_SCHEMA
from choicelens.sources import readers, sinks
from choicelens.streaming import ingest
from conftest import SF001

RAW_HEADER = ",".join(f.name for f in RAW_SCHEMA.fields)


def _raw_lines():
    return [
        "AT,f1,BMW GMBH,t,v1,e,m,X1,1500,120,petrol,M,1998,110,,2020,10",
        "AT,f1,BMW AG,t,v1,e,m,X1,1500,120,Petrol,M,1998,110,,2020,5",
        "DE,f2,duplicate,t,v2,e,m,X2,1600,130,diesel,M,1998,120,,2021,3",
        "US,f3,FORD,t,v3,e,m,X3,1400,100,petrol,M,1200,80,,2020,4",
        "FR,f4,RENAULT,t,v4,e,m,ZOE,1500,0,electric,M,,80,170,2012,4",
        "FR,f4,RENAULT,t,v4,e,m,ZOE,1500,0,ELECTRIC,M,,80,170,2022,6",
    ]


def test_csv_typed_and_strings(spark, tmp_dir):
    p = os.path.join(tmp_dir, "raw.csv")
    with open(p, "w") as f:
        f.write(RAW_HEADER + "\n" + "\n".join(_raw_lines()) + "\n")
    typed = readers.read_csv_typed(spark, p, RAW_SCHEMA)
    assert typed.count() == 6 and dict(typed.dtypes)["r"] == "bigint"
    strs = readers.read_csv_strings(spark, p)
    assert set(t for _, t in strs.dtypes) == {"string"}


def test_title_line_and_glob(spark, tmp_dir):
    p = os.path.join(tmp_dir, "wide.csv")
    with open(p, "w") as f:
        f.write("Title of the table,,\nFuel Type,Country,2020\nTotal,Austria,10\n"
                "Petrol,Austria,..\n")
    df = readers.read_csv_title_line(spark, p)
    assert df.columns[:3] == ["Fuel Type", "Country", "2020"]
    assert [r["Fuel Type"] for r in df.orderBy("_row_idx").collect()] == ["Total", "Petrol"]
    # a bare title does not fix the number of columns; files keep their own header
    d = os.path.join(tmp_dir, "bare")
    os.makedirs(d)
    body = "".join(f"F{i},Austria,{i},{i + 1}\n" for i in range(400))
    for name, title, head in (("a.csv", "New registrations\n", "Fuel Type,Country,2020,2021\n"),
                              ("b.csv", "T,,,\n", "Fuel Type,Country,2020,2022\n")):
        with open(os.path.join(d, name), "w") as f:
            f.write(title + head + body)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1500")     # several splits a file
    try:
        df = readers.read_csv_title_line(spark, d)
        assert set(df.columns) == {"Fuel Type", "Country", "2020", "2021", "2022", "_file", "_row_idx"}
        got = df.orderBy("_row_idx").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    for name, col in (("a.csv", "2021"), ("b.csv", "2022")):
        mine = [r for r in got if r["_file"].endswith(name)]
        assert [r["Fuel Type"] for r in mine] == [f"F{i}" for i in range(400)]
        assert [r[col] for r in mine] == [str(i + 1) for i in range(400)]
    d = os.path.join(tmp_dir, "many")
    os.makedirs(d)
    for name in ("a.csv", "b.csv", "skip_c.csv"):
        with open(os.path.join(d, name), "w") as f:
            f.write("x,y\n1,2\n")
    g = readers.read_csv_glob(spark, d, exclude_prefix="skip_")
    assert sorted(r[0] for r in g.select("_file_name").distinct().collect()) == ["a.csv", "b.csv"]


def _write(folder, files):
    os.makedirs(folder)
    for name, text in files.items():
        with open(os.path.join(folder, name), "w") as f:
            f.write(text)
    return folder


def test_glob_reads_each_file_by_its_own_header(spark, tmp_dir):
    d = _write(os.path.join(tmp_dir, "own heads %41"), {
        "one.csv": "a,b,c\n1,2,3\n", "two.csv": "b,a,c\n20,10,30\n", "three.csv": 'a,d\n"x, y",z\n'})
    got = readers.read_csv_glob(spark, d)
    assert got.columns == ["a", "b", "c", "d", "_corrupt_record", "_file_name"]
    assert {tuple(r) for r in got.collect()} == {
        ("1", "2", "3", None, None, "one.csv"), ("10", "20", "30", None, None, "two.csv"),
        ("x, y", None, None, "z", None, "three.csv")}


def test_glob_keeps_records_that_do_not_fit(spark, tmp_dir):
    d = _write(os.path.join(tmp_dir, "bad"), {
        "good.csv": "a,b\n1,2\n", "long.csv": "a,b\n1,2,3\n4,5\n", "short.csv": "a,b\n7\n", "empty.csv": "", "head.csv": "a,b\n"})
    got = {(r["_file_name"], r["a"], r["b"], r["_corrupt_record"]) for r in readers.read_csv_glob(spark, d).collect()}
    assert got == {("good.csv", "1", "2", None), ("long.csv", "1", "2", "1,2,3"), ("long.csv", "4", "5", None),
                   ("short.csv", "7", None, "7")}
    report = {r["file_name"]: (r["n_rows"], r["n_corrupt"], r["error"]) for r in readers.csv_file_report(spark, d).collect()}
    assert report == {"good.csv": (1, 0, None), "long.csv": (2, 1, "records that do not fit the header"),
                      "short.csv": (1, 1, "records that do not fit the header"), "empty.csv": (0, 0, "no records"),
                      "head.csv": (0, 0, "no records")}


def test_parquet_sink_partitioned(spark, tmp_dir):
    o = readers.read_table(spark, SF001, "orders", ["o_orderkey", "o_orderdate"]).withColumn(
        "year", F.year("o_orderdate"))
    out = os.path.join(tmp_dir, "orders_by_year")
    sinks.write_parquet(o, out, partition_by="year")
    back = spark.read.parquet(out)
    assert back.count() == o.count()
    assert back.where("year = 1996").count() == o.where("year = 1996").count()
    sinks.write_csv(o.select("o_orderkey"), os.path.join(tmp_dir, "csv"))


def test_streaming_ingest(spark, tmp_dir):
    src = os.path.join(tmp_dir, "drop")
    os.makedirs(src)
    lines = _raw_lines()
    for i, chunk in enumerate((lines[:3], lines[3:])):
        with open(os.path.join(src, f"part{i}.csv"), "w") as f:
            f.write(RAW_HEADER + "\n" + "\n".join(chunk) + "\n")
    target = os.path.join(tmp_dir, "clean")
    q = ingest.ingest(ingest.stream_raw_csv(spark, src, max_files_per_trigger=1), target,
                      os.path.join(tmp_dir, "ckpt"))
    q.awaitTermination(120)
    out = spark.read.parquet(target)
    # US (not reporting), 2012 (out of range) and the 'duplicate' maker are dropped
    assert out.count() == 3
    assert sorted(r["manufacturer"] for r in out.collect()) == ["BMW AG", "BMW AG", "RENAULT"]
    assert {r["energy"] for r in out.collect()} == {"Petrol (excluding hybrids)", "Electricity"}


def test_streaming_running_totals(spark, tmp_dir):
    src = os.path.join(tmp_dir, "drop2")
    os.makedirs(src)
    with open(os.path.join(src, "p.csv"), "w") as f:
        f.write(RAW_HEADER + "\n" + "\n".join(_raw_lines()) + "\n")
    stream = ingest.clean_rows(ingest.stream_raw_csv(spark, src))
    q = (ingest.running_totals(stream).writeStream.outputMode("complete").format("memory")
         .queryName("running_totals_test")
         .option("checkpointLocation", os.path.join(tmp_dir, "ckpt2"))
         .trigger(availableNow=True).start())
    q.awaitTermination(120)
    got = {(r["year"], r["energy"]): r["registrations"]
           for r in spark.sql("select * from running_totals_test").collect()}
    assert got == {(2020, "Petrol (excluding hybrids)"): 15, (2022, "Electricity"): 6}
