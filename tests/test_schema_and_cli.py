import pytest
from pyspark.sql import functions as F

from tallymill import cli
from tallymill.domain import Domain, EncodedData
from tallymill.functions import census, schema as sc
from tallymill.operators import setquery as sq
from tallymill.sources import io


def persons(spark):
    rows = [(1, i % 4, i % 3, i % 2, i % 116, 1 + i % 2, 1 + i % 63, 1 + i % 5 % 2) for i in range(400)]
    return spark.createDataFrame(rows, "TABBLKST int, TABBLKCOU int, TABTRACTCE int, TABBLK int, QAGE int, QSEX int, CENRACE int, CENHISP int")


def test_schema(spark):
    df = spark.createDataFrame([("x", 2), ("y", 1), (None, 2)], "s string, n int")
    s = sc.DataSchema.infer(df)
    assert s.values == {"s": ["x", "y"], "n": [1, 2]} and s.domain == Domain(("s", "n"), (2, 2)) and s.index("n") == 1 and len(s) == 2
    assert s.row_space_size() == 4 and s.row_space(spark).distinct().count() == 4
    assert "s: 2 values" in str(s)
    with pytest.raises(ValueError):
        s.add_column("s", [])


def test_census_queries_count_persons(spark):
    raw = persons(spark)
    schema, df = sc.census_schema(raw)
    coded = sc.census_encoder(schema).fit_transform(df)
    cells = census.cells_of(tract=True)
    queries = census.by_block([c for c in cells if c.table in ("P1", "P6", "PCT1")], schema.values["TABBLK"])
    found = {r.qid: r.ans for r in sq.set_answers(EncodedData(coded, schema.domain), sc.coded_queries(queries, schema), density=False).collect()}
    people = df.collect()
    for i, q in enumerate(queries):
        assert found[i] == sum(all(r[a] in vs for a, vs in q.items()) for r in people)
    assert sc.census_schema(raw, blocks=False)[0].values["TABBLK"] == [-1]


def test_places(spark, tmp_path):
    raw = persons(spark)
    sc.write_places(raw, {"state": "TABBLKST", "county": "TABBLKCOU", "tract": "TABTRACTCE", "block": "TABBLK"}, "county", f"{tmp_path}/p")
    back = spark.read.option("basePath", f"{tmp_path}/p").parquet(f"{tmp_path}/p")
    assert back.count() == 400 and back.select("geoid").distinct().count() == 4
    assert sc.random_place(raw, "TABTRACTCE", 1) == sc.random_place(raw.repartition(7), "TABTRACTCE", 1)


def test_releases_of_places(spark, tmp_path):
    raw, names = persons(spark), {"state": "TABBLKST", "county": "TABBLKCOU", "tract": "TABTRACTCE", "block": "TABBLK"}
    release = sc.release_places(raw, names, "county")
    release.write(f"{tmp_path}/r")
    release.write(f"{tmp_path}/r")  # what is there stays
    back = {n: spark.read.option("basePath", f"{tmp_path}/r/{n}").parquet(f"{tmp_path}/r/{n}") for n in ("rows", "domain", "queries")}
    assert back["rows"].count() == 400 and back["rows"].select("geoid").distinct().count() == 4
    sizes = {(r.geoid, r.attr): r["size"] for r in release.domain.collect()}
    people = [r.asDict() for r in raw.collect()]
    place = sorted({g for g, _ in sizes})[1]
    own = [p for p in people if f"{p['TABBLKST']:02}{p['TABBLKCOU']:03}" == place]
    assert sizes[place, "TABBLK"] == len({p["TABBLK"] for p in own}) and sizes[place, "QAGE"] == 116
    # a query set and its answers over the place's coded rows, against the raw persons
    queries = [q for q in release.queries.where((F.col("geoid") == place) & F.col("table_name").isin("P6", "P12")).collect()]
    blocks = sorted({p["TABBLK"] for p in own})
    coded = release.rows.where(F.col("geoid") == place)
    asked = [{a: v for a, v in {"TABBLK": [q.block], "QAGE": q.ages, "QSEX": q.sexes, "CENRACE": q.races, "CENHISP": q.origins}.items() if v is not None} for q in queries]
    data = EncodedData(coded, Domain.fromdict({r.attr: r["size"] for r in release.domain.where(F.col("geoid") == place).collect()}))
    found = {r.qid: r.ans for r in sq.set_answers(data, asked, density=False).collect()}
    cells = {(c.table, c.cell): c.allowed() for c in census.census_cells()}
    label = lambda p: {"QAGE": p["QAGE"], "QSEX": "Male" if p["QSEX"] == 1 else "Female", "CENRACE": p["CENRACE"], "CENHISP": census.NOT_HLO if p["CENHISP"] == 1 else census.HLO}
    for i, q in enumerate(queries):
        allowed = cells[q.table_name, q.cell]
        assert found[i] == sum(p["TABBLK"] == blocks[q.block] and all(label(p)[a] in v for a, v in allowed.items()) for p in own)
    whole = sc.release_places(raw, names, "state", blocks=False)
    assert {r["size"] for r in whole.domain.where("attr = 'TABBLK'").collect()} == {1}


@pytest.mark.parametrize("flags", [["mwem", "--recycle", "--average"], ["pep", "--max_iters", "2", "--public", "other"], ["gem", "--network", "--ema_weights", "--public", "other"], ["rap"], ["iter"], ["mw"], ["ep", "--max_iters", "1"], ["nondp"], ["nondp", "--set_queries", "SETS"]])
def test_command_line(spark, tmp_path, flags, monkeypatch):
    (tmp_path / "domain").mkdir()
    for name in ("toy", "other"):
        Domain(("a", "b"), (2, 3)).to_json(f"{tmp_path}/domain/{name}-domain.json", spark)
    io.save_queries([{"a": [0], "b": [1, 2]}, {"b": [0]}], f"{tmp_path}/q.json", spark)
    flags = [f"{tmp_path}/q.json" if f == "SETS" else f for f in flags]
    spark.range(90).select((F.col("id") % 2).alias("a"), (F.col("id") % 3).alias("b")).write.parquet(f"{tmp_path}/other.parquet")
    spark.range(600).select((F.col("id") % 2).alias("a"), (F.col("id") % 3).alias("b")).write.parquet(f"{tmp_path}/toy.parquet")
    more = ["--root", str(tmp_path), "--dataset", "toy", "--marginal", "1", "--T", "2", "--epsilon", "5", "--K", "20", "--dim", "4", "--results", f"{tmp_path}/r"]
    args = cli.parser().parse_args([*flags, *more, *(["--max_iters", "20"] if "--max_iters" not in flags else [])])
    errors = cli.run(spark, args)
    assert 0 <= errors["error_mean"] <= errors["error_max"] <= 1
    stored = spark.read.parquet(f"{tmp_path}/r").first()
    assert stored["algorithm"] == flags[0] and stored["error_max"] == errors["error_max"] and stored["eta_min"] is None
    monkeypatch.setattr(cli, "_errors", None)  # what is stored isn't run again
    assert cli.run(spark, args) == errors
    args.seed += 1
    with pytest.raises(TypeError):
        cli.run(spark, args)
