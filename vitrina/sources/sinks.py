"""Writers: snapshot exports and report files."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import datetime

from pyspark.sql import DataFrame, Observation, functions as F

from vitrina.operators.ingest import valid_listing, valid_posting
from vitrina.plans.clean import export_listing_rows, export_posting_rows

# A part file of a snapshot stays small enough to be read by one task.
RECORDS_PER_FILE = 500_000
# Reports whose number of rows is fixed by the labels; only these are gathered into one file.
BOUNDED_REPORTS = (
    "productos_por_rango_precio", "empleos_por_fecha_publicacion", "empleos_por_nivel_experiencia", "reporte_resumen",
)


def write_csv(rows: DataFrame, path: str, mode: str = "errorifexists", records_per_file: int = RECORDS_PER_FILE) -> None:
    """Headed CSV; `records_per_file` 0 leaves one file a task."""
    (
        rows.write.mode(mode)
        .option("header", True)
        .option("quote", '"')
        .option("escape", '"')
        .option("emptyValue", "")
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .option("maxRecordsPerFile", records_per_file)
        .csv(path)
    )


def write_snapshot(rows: DataFrame, path: str, fmt: str = "csv") -> None:
    """A snapshot directory: CSV as it is exchanged with other programs, or a columnar format that later runs read in part."""
    if fmt == "csv":
        write_csv(rows, path)
    else:
        rows.write.option("maxRecordsPerFile", RECORDS_PER_FILE).format(fmt).save(path)


def _export(rows, exported, valid, out_dir, prefix, stamp, observation, probe, fmt) -> str | None:
    if (rows if probe is None else probe).isEmpty():
        return None
    stamp = stamp or datetime.now().strftime("%Y%m%d_%H%M%S")
    path = f"{out_dir.rstrip('/')}/{prefix}{stamp}.{fmt}"
    if observation is not None:
        exported = exported.observe(
            observation, F.count(F.lit(1)).alias("rows_in"), F.count_if(valid).alias("rows_valid")
        )
    write_snapshot(exported.where(valid), path, fmt)
    return path


def export_listings(
    listings: DataFrame,
    out_dir: str,
    prefix: str = "listings_",
    stamp: str | None = None,
    observation: Observation | None = None,
    probe: DataFrame | None = None,
    fmt: str = "csv",
) -> str | None:
    """Clean, validate and write listings as one snapshot directory; its path, or None (nothing written) without rows.

    `probe` is a cheaper frame that is empty exactly when `listings` is, such as the rows before deduplication.
    `observation` receives rows_in and rows_valid from the same job. `fmt` is csv or parquet.
    """
    valid = valid_listing(F.col("producto"), F.col("precio"))
    return _export(listings, export_listing_rows(listings), valid, out_dir, prefix, stamp, observation, probe, fmt)


def export_postings(
    postings: DataFrame,
    out_dir: str,
    prefix: str = "postings_",
    stamp: str | None = None,
    observation: Observation | None = None,
    probe: DataFrame | None = None,
    fmt: str = "csv",
) -> str | None:
    """Same for postings."""
    valid = valid_posting(F.col("titulo_puesto"), F.col("empresa"))
    return _export(postings, export_posting_rows(postings), valid, out_dir, prefix, stamp, observation, probe, fmt)


def write_reports(reports: Mapping[str, DataFrame], out_dir: str, fmt: str = "csv") -> dict[str, str]:
    """Write every report below `out_dir`, replacing earlier output; returns the paths."""
    paths = {}
    for name, report in reports.items():
        paths[name] = f"{out_dir.rstrip('/')}/{name}.{fmt}"
        out = report.coalesce(1) if name in BOUNDED_REPORTS else report
        if fmt == "csv":
            write_csv(out, paths[name], "overwrite")
        else:
            out.write.mode("overwrite").format(fmt).save(paths[name])
    return paths
