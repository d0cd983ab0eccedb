import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from needscope import schemas
from needscope.config import Config
from needscope.operators import quality
from needscope.plans import medallion
from needscope.sources import readers, sinks
from needscope.sources.scratch import scratch_dir, settle
from tests import golden
from tests.test_projects import random_projects

HEADER = ("Country,ISO3,Year,PeopleInNeed_M,RequiredFunding_M_USD,FundingReceived_M_USD,"
          "CBPFAllocation_M_USD,Severity,PrimaryCluster,Region,Lat,Lon")


def write(path, text, encoding):
    path.write_bytes(text.encode(encoding))
    return str(path)


@pytest.mark.parametrize("encoding", ["utf-8", "latin-1"])
def test_csv_in_both_encodings(spark, tmp_path, encoding):
    path = write(tmp_path / "needs.csv", "name,n\nCôte d'Ivoire,1\nPérou,x\n", encoding)
    rows = readers.scan_csv(spark, path, readers.T.StructType.fromDDL("name string, n int"), corrupt="bad").collect()
    assert [(r.name, r.n) for r in rows] == [("Côte d'Ivoire", 1), ("Pérou", None)]
    assert rows[0].bad is None and rows[1].bad == "Pérou,x"


def test_needs_file_to_contract(spark, tmp_path):
    path = write(tmp_path / "needs.csv", f"{HEADER}\nSudan,SDN,2023,18.0,2571,583,34,4,WASH,East Africa,12.9,30.2\n", "utf-8")
    text = spark.read.option("header", True).csv(path)
    row = readers.conform(readers.normalise_columns(text), schemas.NEEDS, schemas.NEEDS_FILE_NAMES).first()
    assert (row.country, row.year, row.required_funding_musd, row.population_millions) == ("Sudan", 2023, 2571.0, None)


def test_header_rules(spark):
    df = spark.createDataFrame([(1, 2)], ["  People In\tNeed (M) ", "ISO-3"])
    assert readers.normalise_columns(df).columns == ["people_in_need_m", "iso3"]
    with pytest.raises(ValueError, match="clash"):
        readers.normalise_columns(spark.createDataFrame([(1, 2)], ["A b", "a_B"]))


def test_conform_turns_bad_text_into_null(spark):
    df = spark.createDataFrame([("2023", "x")], "year string, severity string")
    row = readers.conform(df, schemas.NEEDS).first()
    assert row.year == 2023 and row.severity is None and row.country is None


def test_load_or_fallback(spark):
    full, other = spark.range(3), spark.range(10, 12)
    assert readers.load_or_fallback(full, other).count() == 3
    assert readers.load_or_fallback(full.filter("id > 9"), other).count() == 2
    assert readers.load_or_fallback(None, other).count() == 2


def test_tables_are_replaced_with_their_schema(spark, tmp_path):
    database = "sinks_test"
    sinks.ensure_database(spark, database, str(tmp_path / "db"))
    assert spark.catalog.currentDatabase() == database
    sinks.save_table(spark.range(3), f"{database}.t")
    sinks.save_table(spark.range(5).withColumn("g", F.col("id") % 2), f"{database}.t", partition_by=["g"])
    assert spark.table("t").columns == ["id", "g"] and spark.table("t").count() == 5
    inventory = {r.table_name: (r.n_rows, r.n_cols) for r in sinks.table_inventory({"t": spark.table("t")}).collect()}
    assert inventory == {"t": (5, 2), "TOTAL": (5, 2)}
    report = sinks.schema_report(spark.table("t")).orderBy("position").collect()
    assert [(r.column_name, r.type_name, r.n_values) for r in report] == [("id", "bigint", 5), ("g", "bigint", 5)]
    spark.catalog.setCurrentDatabase("default")


def test_scratch_follows_the_session(spark):
    named = spark.conf.get("spark.checkpoint.dir", None)
    assert scratch_dir(spark) == (named.rstrip("/") if named else scratch_dir(spark))


def test_all_tables_end_to_end(spark, tmp_path):
    sources = {
        "needs": golden.needs(spark),
        "projects": golden.projects(spark, random_projects(8, 90)),
        "allocations": golden.allocations(spark),
    }
    sink = medallion.table_sink(spark, "run_test", str(tmp_path / "db"))
    tables = medallion.run(sources, sink)
    spark.catalog.setCurrentDatabase("default")
    widths = {name: len(df.columns) for name, df in tables.items()}
    assert widths == {
        "needs": 13, "projects": 11, "allocations": 7, "silver_funding": 26, "silver_projects": 20,
        "silver_allocations": 15, "gold_rankings": 28, "gold_regional": 12, "gold_cluster": 9,
        "gold_mismatch": 15, "gold_benchmarks": 20, "gold_comparables": 4,
    }
    assert tables["silver_allocations"].count() == 29 and tables["gold_benchmarks"].count() == 90
    assert tables["gold_rankings"].orderBy("global_overlook_rank").first().iso3 == "SDN"


def test_csv_columns_are_taken_by_name(spark, tmp_path):
    file = tmp_path / "any-order.csv"
    file.write_text('n,other,name\n7,x,"Su\ndan"\n8,y,Mali\n')
    found = readers.scan_csv(spark, str(file), T.StructType.fromDDL("name string, n int, missing double"), multi_line=True)
    assert sorted(map(tuple, found.collect())) == [("Mali", 8, None), ("Su\ndan", 7, None)]


def test_encoding_goes_by_file_in_one_scan(spark, tmp_path):
    folder = tmp_path / "mixed"
    folder.mkdir()
    write(folder / "a.csv", "name,n,note\nCôte d'Ivoire,1,é\nPlain,2,\n", "utf-8")
    # the first row alone would pass as UTF-8
    write(folder / "b.csv", "name,n,note\nÃ©,3,x\nPérou,4,y\n", "latin-1")
    schema = T.StructType.fromDDL("name string, n int")
    rows = readers.scan_csv(spark, str(folder), schema)
    assert sorted(map(tuple, rows.collect())) == sorted([("Côte d'Ivoire", 1), ("Plain", 2), ("Ã©", 3), ("Pérou", 4)])
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "csv" not in plan.lower().split("location")[0] and "FileScan parquet" in plan
    held, names = readers._held_csv(spark, str(folder), schema, None, False, True)
    parsed, _ = readers._parsed_csv(spark, str(folder), schema, readers.LATIN, None, False, True)
    assert names == ["name", "n", "note"] and parsed._jdf.queryExecution().executedPlan().toString().count("FileScan csv") == 1
    assert {r[0].rsplit("/", 1)[1] for r in held.filter(readers.OTHER).select(readers.FILE).collect()} == {"b.csv"}


def test_bad_records_have_their_own_table(spark, tmp_path):
    folder = tmp_path / "bad"
    folder.mkdir()
    write(folder / "a.csv", "naïve,n\nx,1\ny,oops\nz,3,4\n", "utf-8")
    write(folder / "b.csv", "naïve,n\né,5\n", "utf-8")
    found = readers.read_csv(spark, str(folder), T.StructType.fromDDL("n int, `naïve` string, absent date"))
    assert sorted(map(tuple, found.rows.collect())) == [(1, "x", None), (5, "é", None)]
    assert sorted(r.record for r in found.bad.collect()) == ["y,oops", "z,3,4"]
    told = {r.file.rsplit("/", 1)[1]: (r.encoding, r.n_rows, r.n_bad) for r in found.files.collect()}
    assert told == {"a.csv": ("UTF-8", 3, 2), "b.csv": ("UTF-8", 1, 0)}
    text = readers.read_csv(spark, str(folder))
    assert text.rows.columns == ["naïve", "n"] and text.bad.count() == 1 and text.rows.count() == 3


def test_from_files_to_report(spark, tmp_path):
    needs = golden.needs(spark)
    back = {new: old for old, new in schemas.NEEDS_FILE_NAMES.items()}
    paths = {name: str(tmp_path / name) for name in ("needs", "projects", "allocations")}
    needs.select(*[F.col(c).alias(back[c]) for c in needs.columns if c in back]).coalesce(1).write.option("header", True).csv(paths["needs"])
    golden.projects(spark, random_projects(8, 90)).coalesce(1).write.option("header", True).csv(paths["projects"])
    golden.allocations(spark).coalesce(1).write.option("header", True).csv(paths["allocations"])
    tables = medallion.run_files(spark, paths)
    direct = medallion.silver_funding(needs.withColumn("population_millions", F.lit(None).cast("double")))
    order = lambda df: sorted(map(str, df.select("iso3", "overlook_score", "global_overlook_rank").collect()))
    assert order(tables["silver_funding"]) == order(direct)
    assert {(r.source, r.n_bad) for r in tables["input_files"].collect()} == {("needs", 0), ("projects", 0), ("allocations", 0)}
    report = tables["quality_report"].collect()
    assert {r.check for r in report} == {"null_counts", "impossible_rows", "required_columns", "contract_checks"} and all(r.passed for r in report)
    assert {r.table_name for r in tables["inventory"].collect()} >= {"gold_comparables", "silver_projects", "TOTAL"}
    pairs = tables["gold_comparables"].join(tables["gold_benchmarks"].select("project_code", "benchmark_group"), "project_code")
    assert pairs.select("project_code").distinct().count() > 60


def test_lost_write_keeps_the_old_table(spark, tmp_path):
    name = "versions_test"
    before = spark.catalog.currentDatabase()
    sinks.ensure_database(spark, name, str(tmp_path / "db"))
    spark.catalog.setCurrentDatabase(before)
    table, path = f"{name}.t", str(tmp_path / "files")
    spark.range(2).write.option("path", str(tmp_path / "plain")).saveAsTable(table)
    sinks.save_table(spark.range(3).withColumn("g", F.lit("007")), table, ["g"], path)
    old = spark.table(table)
    broken = spark.range(9).select(F.when(F.col("id") == 8, F.raise_error(F.lit("lost"))).otherwise(F.col("id")).cast("long").alias("id"))
    with pytest.raises(Exception, match="lost"):
        sinks.save_table(broken, table, path=path)
    assert len(sinks.versions(spark, table)) == 1
    assert sorted((r.id, r.g) for r in spark.table(table).collect()) == [(0, "007"), (1, "007"), (2, "007")]
    sinks.save_table(spark.table(table).filter("id > 0").withColumn("more", F.lit(1)), table, path=path)
    assert old.count() == 3
    assert spark.table(table).columns == ["id", "g", "more"] and spark.table(table).count() == 2
    first, second = sinks.versions(spark, table)
    assert sinks.drop_versions(spark, table) == [first] and sinks.versions(spark, table) == [second]
    assert sinks.drop_versions(spark, table) == [] and spark.table(table).count() == 2
    with pytest.raises(ValueError, match="at least one"):
        sinks.drop_versions(spark, table, keep=0)


def test_gate_counts_sets_aside_and_fails(spark):
    df = spark.createDataFrame([(1, 5, 1), (2, None, 2), (3, -1, 3), (4, -1, 9), (4, -1, 9)], "id int, broken_rules int, `set.aside` int")
    rule = lambda name, bad, action="report": quality.Rule("mine", name, bad, action)
    negative, large = F.col("broken_rules") < 0, F.col("id") > 3
    found = quality.gate(df, [rule("none", F.col("broken_rules").isNull()), rule("negative", negative, "set_aside"), rule("large", large, "set_aside")])
    assert [(r.rule, r.n_bad, r.passed) for r in found.report.collect()] == [("none", 1, False), ("negative", 3, False), ("large", 2, False)]
    assert found.kept.columns == df.columns and sorted(map(tuple, found.kept.collect())) == [(1, 5, 1), (2, None, 2)]
    assert found.aside.columns == [*df.columns, "broken_rules_"]
    assert sorted((r[0], r[3]) for r in found.aside.collect()) == [(3, ["negative"]), (4, ["negative", "large"]), (4, ["negative", "large"])]
    with pytest.raises(quality.QualityError, match="mine.negative: 3 rows"):
        quality.gate(df, [rule("negative", negative, "fail")])
    empty = quality.gate(df.limit(0), [rule("negative", negative, "fail"), rule("large", large, "set_aside")])
    assert empty.kept.count() == empty.aside.count() == 0 and all(r.passed for r in empty.report.collect())
    assert quality.gate(df, []).kept.count() == 5
    with pytest.raises(ValueError, match="same check"):
        quality.gate(df, [rule("a", negative), rule("a", large)])
    report = quality.gate(golden.needs(spark), quality.needs_rules(golden.needs(spark))).report.filter("not passed")
    assert report.count() == 0
    lacking = [r for r in quality.needs_rules(golden.needs(spark).drop("year")) if r.check == "required_columns"]
    told = quality.gate(golden.needs(spark).drop("year"), lacking).report.filter("not passed").collect()
    assert [(r.rule, r.n_bad) for r in told] == [("year", golden.needs(spark).count())]


def test_run_with_rules(spark, tmp_path):
    needs = golden.needs(spark)
    first = needs.orderBy("iso3").first().iso3
    sources = {"needs": needs, "projects": golden.projects(spark, random_projects(8, 90)), "allocations": golden.allocations(spark)}
    written = []

    def sink(df, name):
        written.append(name)
        return settle(df, name)

    rules = quality.needs_rules(needs)
    own = lambda action: [*rules, quality.Rule("own", "first", F.col("iso3") == first, action)]
    with pytest.raises(quality.QualityError, match="own.first: 1 rows"):
        medallion.run(sources, sink, rules={"needs": own("fail")})
    assert written == []
    tables = medallion.run(sources, sink, rules={"needs": own("set_aside")})
    assert [r.iso3 for r in tables["needs_aside"].collect()] == [first]
    assert tables["silver_funding"].count() == needs.count() - 1
    assert {(r.source, r.rule) for r in tables["quality_report"].filter("not passed").collect()} == {("needs", "first")}
    with pytest.raises(ValueError, match="unknown sources"):
        medallion.run(sources, sink, rules={"need": []})


# ---- by analysis year ----

def two_years(spark, path):
    """Needs and allocations of 2023, and of 2024 with a tenth of the money, partitioned by year."""
    sources = {"needs": golden.needs(spark).dropDuplicates(["iso3"]), "allocations": golden.allocations(spark)}
    for name, df in sources.items():
        money = "funding_received_musd" if name == "needs" else "allocation_musd"
        later = df.withColumns({"year": F.lit(2024), money: F.col(money) / 10})
        df.unionByName(later).write.partitionBy("year").parquet(f"{path}/{name}")
    return {name: spark.read.parquet(f"{path}/{name}") for name in sources}


def test_a_year_is_ranked_by_itself_and_replaced_alone(spark, tmp_path):
    sources = two_years(spark, tmp_path)
    home = f"{tmp_path}/tables"
    for year in (2023, 2024):
        tables = medallion.run_funding(sources, medallion.year_sink(spark, home, year), Config(year=year))
        assert {r[0] for r in tables["needs"].select("year").distinct().collect()} == {year}
        alone = {name: df.filter(F.col("year") == year) for name, df in sources.items()}
        for name, df in medallion.run_funding(alone).items():
            assert sorted(map(str, df.collect())) == sorted(map(str, tables[name].select(df.columns).collect())), name
    both = sinks.read_years(spark, f"{home}/gold_rankings")
    n_rows = both.count()
    tops = both.filter("global_overlook_rank = 1").groupBy("analysis_year").count().collect()
    assert {r.analysis_year for r in tops} == {2023, 2024}

    files = lambda year: sorted(p.name for p in (tmp_path / "tables").glob(f"*/analysis_year={year}/*.parquet"))
    former = {year: files(year) for year in (2023, 2024)}
    medallion.run_funding(sources, medallion.year_sink(spark, home, 2024), Config(year=2024))
    assert files(2023) == former[2023] and not set(files(2024)) & set(former[2024])
    assert sinks.read_years(spark, f"{home}/gold_rankings").count() == n_rows


def test_a_run_of_a_year_reads_the_files_of_that_year(spark, tmp_path):
    sources = two_years(spark, tmp_path)
    for df in sources.values():
        found = medallion.of_year(df, Config(year=2024))
        text = found._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters: [isnotnull(year" in text and "= 2024)" in text
        assert {r[0].split("/year=")[1][:4] for r in found.select(F.input_file_name()).distinct().collect()} == {"2024"}
        assert medallion.of_year(df, Config()) is df


def test_replacing_a_year_survives_a_lost_write_and_empties(spark, tmp_path):
    path = f"{tmp_path}/t"
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "x int, analysis string")
    for year in (2023, 2024):
        sinks.replace_year(rows, path, year)
    lost = rows.repartition(3, "x").withColumn("x", F.when(F.col("x") == 2, F.raise_error("lost")).otherwise(F.col("x")).cast("int"))
    with pytest.raises(Exception, match="lost"):
        sinks.replace_year(lost, path, 2024)
    assert sinks.read_years(spark, path).count() == 6
    # a table may be replaced by what is read of itself
    sinks.replace_year(sinks.read_year(spark, path, 2024).filter("x > 1"), path, 2024)
    assert sorted(r.x for r in sinks.read_year(spark, path, 2024).collect()) == [2, 3]
    sinks.replace_year(rows.filter("x > 9"), path, 2024)
    sinks.replace_year(rows.limit(0), path, 2025)
    assert sinks.read_year(spark, path, 2024).count() == sinks.read_year(spark, path, 2025).count() == 0
    assert {tuple(r) for r in sinks.read_years(spark, path).groupBy("analysis_year").count().collect()} == {(2023, 3)}
    with pytest.raises(ValueError, match="analysis_year"):
        sinks.replace_year(rows.withColumn("analysis_year", F.lit(1)), path, 2024)
