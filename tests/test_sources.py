"""Round trips through files, choice of the newest snapshot, exports, report files and whole sessions."""

import os
import time

import pytest
from pyspark.sql import Observation, functions as F

from vitrina import fixed_values as fv
from vitrina.plans import run
from vitrina.schemas import LISTING_SCHEMA, POSTING_SCHEMA
from vitrina.sources import sinks, snapshots, staging


def listing(producto="Mesa de roble", precio="$10", **other):
    values = dict(vendedor="Por ACME", ubicacion="", reputacion_vendedor="N/A", fecha_extraccion="2024-02-01", url_producto="http://x/1",
                  disponible="Sí", envio_gratis="No", categoria="mesa") | other
    return (producto, precio, *values.values())


def posting(titulo="Dev", empresa="ACME", **other):
    values = dict(indice="1", fecha_extraccion="2024-02-01", titulo_puesto=titulo, empresa=empresa, ubicacion="Argentina (En remoto)",
                  url_empleo="http://x/1", modalidad="Remoto", fecha_publicacion="Hace 2 días", descripcion_breve="a",
                  nivel_experiencia="No disponible", beneficios_ofrecidos="Sin información") | other
    return tuple(values.values())


def test_round_trip_of_awkward_text(spark, tmp_path):
    texts = ['a "quoted" word', "comma, inside", "two\nlines", " padded ", "back\\slash", "tab\tñandú", 'ends "', "\\", '"', "a\r\nb"]
    frame = spark.createDataFrame([listing(text, text) for text in texts], LISTING_SCHEMA)
    sinks.write_csv(frame, f"{tmp_path}/out.csv")
    back = snapshots.scan_listings(spark, f"{tmp_path}/out.csv")
    want = [text.replace("\r\n", "\n") for text in texts]  # the CSV reader folds line ends inside quotes
    got = sorted(r.producto.replace("\r\n", "\n") for r in back.collect())
    assert got == sorted(want)
    assert back.where("ubicacion IS NULL AND reputacion_vendedor IS NULL").count() == len(texts)


def test_hand_written_file(spark, tmp_path):
    path = tmp_path / "listings_1.csv"
    path.write_text(",".join(fv.LISTING_COLUMNS) + '\n"Mesa, ""grande""",$1.000,NULL,nan,,2024-02-01,http://x,Sí,1,"a\nb"\n', encoding="utf-8")
    row = snapshots.scan_listings(spark, str(path)).first()
    assert tuple(row) == ('Mesa, "grande"', "$1.000", None, None, None, "2024-02-01", "http://x", "Sí", "1", "a\nb")


def test_latest_snapshot(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        snapshots.latest_snapshot(spark, str(tmp_path), "listings_")
    for number, name in enumerate(["listings_b.csv", "listings_a.csv", "other_z.csv", "listings_c.txt"]):
        (tmp_path / name).write_text("x\n")
        os.utime(tmp_path / name, (1000 + number, 1000 + number))
    assert snapshots.latest_snapshot(spark, str(tmp_path), "listings_").endswith("/listings_a.csv")
    os.utime(tmp_path / "listings_b.csv", (2000, 2000))
    assert snapshots.latest_snapshot(spark, str(tmp_path), "listings_").endswith("/listings_b.csv")
    os.utime(tmp_path / "listings_a.csv", (2000, 2000))
    assert snapshots.latest_snapshot(spark, str(tmp_path), "listings_").endswith("/listings_b.csv")
    sinks.write_csv(spark.range(3), f"{tmp_path}/listings_0.csv")
    assert snapshots.latest_snapshot(spark, str(tmp_path), "listings_").endswith("/listings_0.csv")


def test_export(spark, tmp_path):
    rows = [listing(" Mesa\nroble "), listing("abc"), listing("N/A"), listing(precio="N/A"), listing(precio="25"), listing("  ")]
    seen = Observation()
    path = sinks.export_listings(spark.createDataFrame(rows, LISTING_SCHEMA), str(tmp_path), stamp="1", observation=seen)
    assert path == f"{tmp_path}/listings_1.csv" and seen.get == {"rows_in": 6, "rows_valid": 2}
    back = spark.read.csv(path, header=True)
    assert tuple(back.columns) == fv.LISTING_COLUMNS
    assert sorted((r.producto, r.precio, r.ubicacion) for r in back.collect()) == [
        ("Mesa de roble", "$25", "No disponible"), ("Mesa roble", "$10", "No disponible")]
    assert sinks.export_listings(spark.createDataFrame([], LISTING_SCHEMA), str(tmp_path), stamp="2") is None
    assert not os.path.exists(tmp_path / "listings_2.csv")
    with pytest.raises(Exception):
        sinks.export_listings(spark.createDataFrame(rows, LISTING_SCHEMA), str(tmp_path), stamp="1")
    jobs = spark.createDataFrame([posting(), posting("ab"), posting(empresa="N/A"), posting(empresa="  ")], POSTING_SCHEMA)
    kept = spark.read.csv(sinks.export_postings(jobs, str(tmp_path), stamp="1"), header=True).collect()
    assert [(r.titulo_puesto, r.beneficios_ofrecidos) for r in kept] == [("Dev", "No disponible")]


def test_analysis_from_files(spark, tmp_path):
    raw, out = tmp_path / "raw", tmp_path / "out"
    sinks.export_listings(spark.createDataFrame([listing("Silla vieja")], LISTING_SCHEMA), str(raw), stamp="1")
    time.sleep(1.1)
    rows = [listing(f"Mesa {i:04d}", f"${i}0.000", disponible="Sí" if i % 2 else "No") for i in range(1, 41)]
    sinks.export_listings(spark.createDataFrame(rows, LISTING_SCHEMA), str(raw), stamp="2")
    jobs = [posting(f"Dev {i}", f"E{i % 3}", fecha_publicacion=f"Hace {i} días") for i in range(10)]
    sinks.export_postings(spark.createDataFrame(jobs, POSTING_SCHEMA), str(raw), stamp="1")
    for fmt_run in range(2):  # the second run replaces the first
        paths = run.run_analysis(spark, str(raw), str(out), as_of="2024-02-01 12:00:00")
    assert len(paths) == 7
    read = {name: spark.read.csv(path, header=True, inferSchema=True, escape='"') for name, path in paths.items()}
    one = read["reporte_resumen"].first()
    assert (one.total_productos_ml, one.precio_mediano_ml, one.productos_disponibles, one.empleos_remotos) == (40, 205000.0, 20, 10)
    assert [(r.rango_precio, r.cantidad_productos) for r in read["productos_por_rango_precio"].collect()] == [("Bajo", 9), ("Medio", 31)]
    assert {r.categoria_fecha: r.cantidad_empleos for r in read["empleos_por_fecha_publicacion"].collect()} == {
        fv.AGE_FIRST: 1, fv.AGE_WEEK: 7, fv.AGE_OLDER: 2}
    assert read["productos_por_factor_personalizado"].count() == 40
    parquet = sinks.write_reports({"reporte_resumen": read["reporte_resumen"]}, str(out), "parquet")
    assert spark.read.parquet(parquet["reporte_resumen"]).count() == 1


class FakeSession:
    """What `shared_root` asks of a session."""

    def __init__(self, master, checkpoint_dir=None, **settings):
        self.conf, self.settings = self, settings
        self.sparkContext = type("Context", (), {"master": master, "getCheckpointDir": lambda _: checkpoint_dir})()

    def get(self, name, default=None):
        return self.settings.get(name.replace(".", "_"), default)


def test_shared_folder(spark, tmp_path):
    named = FakeSession("spark://host:7077", spark_checkpoint_dir=f"{tmp_path}/shared/")
    assert staging.shared_folder(named).startswith(f"{tmp_path}/shared/vitrina-")
    assert staging.shared_root(FakeSession("yarn", "hdfs://x/check")) == "hdfs://x/check"
    assert staging.shared_root(FakeSession("local[2]", spark_sql_warehouse_dir="file:/w")) == "file:/w"
    for master in ("yarn", "spark://host:7077", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            staging.shared_root(FakeSession(master, spark_sql_warehouse_dir="file:/w"))
    assert staging.shared_folder(spark) != staging.shared_folder(spark)
    staged = staging.stage_table(spark.range(5).select("id", F.lit("x").alias("y")))
    assert staged.count() == 5 and "Range" not in staged._jdf.queryExecution().optimizedPlan().toString()


def test_run_folder_goes_with_its_run(spark):
    from vitrina.sources import hadoop

    with pytest.raises(RuntimeError):
        with staging.run_folder(spark) as folder:
            assert staging.stage_table(spark.range(3).toDF("id"), folder).count() == 3
            assert hadoop.exists(spark, folder)
            raise RuntimeError
    assert not hadoop.exists(spark, folder)


def test_columns_by_name(spark, tmp_path):
    names = [*fv.LISTING_COLUMNS][::-1]
    values = {name: f"v_{name}" for name in names}
    (tmp_path / "moved.csv").write_text(",".join(["extra", *names]) + "\n" + ",".join(["x", *values.values()]) + "\n")
    row = snapshots.scan_listings(spark, f"{tmp_path}/moved.csv").first()
    assert row.asDict() == values and row.__fields__ == [*fv.LISTING_COLUMNS]
    (tmp_path / "short.csv").write_text(",".join(names[1:]) + "\n")
    with pytest.raises(ValueError, match=names[0]):
        snapshots.scan_listings(spark, f"{tmp_path}/short.csv")


def test_unfinished_snapshot_is_not_newest(spark, tmp_path):
    sinks.write_csv(spark.range(3), f"{tmp_path}/listings_1.csv")
    (tmp_path / "listings_2.csv").mkdir()
    (tmp_path / "listings_2.csv" / "part-00000.csv").write_text("id\n1\n")
    assert snapshots.latest_snapshot(spark, str(tmp_path), "listings_").endswith("/listings_1.csv")


def test_analysis_leaves_nothing_behind_and_takes_parquet(spark, tmp_path, monkeypatch):
    shared, raw = tmp_path / "shared", tmp_path / "raw"
    shared.mkdir()
    sinks.export_listings(spark.createDataFrame([listing("Silla vieja"), listing("Mesa nueva", "$20")], LISTING_SCHEMA), str(raw), stamp="1", fmt="parquet")
    sinks.export_postings(spark.createDataFrame([posting()], POSTING_SCHEMA), str(raw), stamp="1", fmt="parquet")
    monkeypatch.setattr(staging, "shared_root", lambda spark: str(shared))
    paths = run.run_analysis(spark, str(raw), str(tmp_path / "out"), as_of="2024-02-01 12:00:00")
    assert list(shared.iterdir()) == []
    assert spark.read.csv(paths["reporte_resumen"], header=True).first().total_productos_ml == "2"
    path = snapshots.latest_snapshot(spark, str(raw), "listings_")
    assert path.endswith(".parquet") and snapshots.scan_listings(spark, path).columns == list(fv.LISTING_COLUMNS)
    with pytest.raises(ValueError, match="no column"):
        snapshots.scan_postings(spark, path)


def test_key_index(spark, tmp_path):
    from vitrina.operators import known_keys

    path = str(tmp_path / "index")
    old = spark.range(3000).select(F.col("id").cast("string").alias("k"))
    new = spark.range(2500, 6000).select(F.col("id").cast("string").alias("k")).unionByName(spark.createDataFrame([(None,), ("",)], "k string"))

    def add(rows):
        known_keys.add_keys(rows.select(known_keys.key_text(F.col("k")).alias("key")), path, buckets=8, chunks=4)

    assert known_keys.unseen(new, F.col("k"), path).count() == 3502  # no index yet
    add(old)
    spark.sql(f"DROP TABLE {known_keys._table(spark, path)}")  # as in a later session: the files stay
    assert known_keys.unseen(new, F.col("k"), path).count() == 3002
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = known_keys.unseen(new, F.col("k"), path)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    scan = text.index("vitrina_keys_")
    assert text.count("Exchange hashpartitioning") <= 1 and "Bucketed: true" in text[scan:]  # what is old is not shuffled
    add(new)
    add(new)
    assert known_keys.unseen(new, F.col("k"), path).count() == known_keys.unseen(old, F.col("k"), path).count() == 0
    assert known_keys.unseen(spark.createDataFrame([("x",)], "k string"), F.col("k"), path).count() == 1


def test_a_replayed_batch_changes_nothing(spark, tmp_path):
    from vitrina.streaming import new_snapshots

    raw, target, checkpoint = (str(tmp_path / name) for name in ("raw", "table", "checkpoint"))

    def take(fmt="csv"):
        return new_snapshots.ingest_new_snapshots(spark, raw, "listings_", LISTING_SCHEMA, target, checkpoint, fmt)

    def stored():
        return sorted((r.snapshot, r.producto) for r in new_snapshots.ingested(spark, LISTING_SCHEMA, target).collect())

    sinks.export_listings(spark.createDataFrame([listing("Silla\n\"vieja\""), listing("Mesa larga")], LISTING_SCHEMA).repartition(2), raw, stamp="1")
    sinks.export_postings(spark.createDataFrame([posting()], POSTING_SCHEMA), raw, stamp="1")
    assert take() >= 1
    first = stored()
    assert [name for name, _ in first] == ["listings_1"] * 2
    assert take() == 0 and stored() == first
    commits = sorted(path for path in (tmp_path / "checkpoint" / "commits").iterdir() if path.name.isdigit())
    for path in (tmp_path / "checkpoint" / "commits").glob(f"*{commits[-1].name}*"):
        path.rename(tmp_path / f"kept-{path.name}")  # as after a failure between the batch and its commit
    assert take() >= 1 and stored() == first
    sinks.write_snapshot(spark.createDataFrame([listing("Banco N/A"), listing(vendedor="N/A")], LISTING_SCHEMA).coalesce(1), f"{raw}/listings_2.csv")
    assert take() == 1 and [name for name, _ in stored()].count("listings_2") == 2
    assert new_snapshots.ingested(spark, LISTING_SCHEMA, target).where("vendedor IS NULL").count() == 1
