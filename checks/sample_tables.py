"""Listing, posting, detail and page tables derived from the given parquet tables, row by row and at any size.

The snapshot-like tables are SELECT texts that Spark and DuckDB both read, so that the query and its check start from the
same rows. The page tables exist only in Spark, which renders HTML from the given rows.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from vitrina.sources import pages as page_source, staging

AS_OF = "2024-02-01 12:00:00"
LISTING_HOST = "https://articulos.example.com"
POSTING_HOST = "https://empleos.example.com"

LISTING_ORDER = ("orden_1", "orden_2", "orden_3", "orden_4", "orden_5")
POSTING_ORDER = ("term_no", "pos")
LISTING_TERMS = ("ECONOMY", "STANDARD", "PROMO", "SMALL", "MEDIUM", "LARGE")
SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
POSTING_TERMS = ("click", "view", "purchase", "signup", "error")


def _choice(expr: str, texts) -> str:
    """CASE over the remainder; None gives NULL."""
    arms = " ".join(
        f"WHEN {number} THEN " + ("NULL" if text is None else "'" + text.replace("'", "''") + "'")
        for number, text in enumerate(texts)
    )
    return f"CASE {expr} % {len(texts)} {arms} END"


REPUTATIONS = (
    "Reputación VERDE", "Muy buena atención", "Vendedor excelente", "Tarjeta amarilla", "reputación Regular",
    "Zona roja", "Mala experiencia", "Vendedor nuevo", "Sin reputación aún", "No disponible", "Platino", "N/A", "",
    "Málaga centro", "Malaga centro",
)
PLACES = (
    "Argentina (En remoto)", "Buenos Aires y alrededores (Híbrido)", "Comuna 4 (Presencial)", "Rosario", "No encontrado",
    "", "N/A", "Ciudad de Córdoba",
)
MODES = (
    "Remoto", "En REMOTO", "Fully remote", "Presencial", "On-site", "Oficina central", "Híbrido", "hybrid work",
    "No encontrado", "No disponible", "no-aplica", "jornada PARTIDA", "N/A",
)
LEVELS = (
    "Senior Developer", "developer sr", "Junior developer", "Developer jr", "desenvolvedor", "Entry level", "JUNIOR",
    "Trainee program", "Senior", "Sr. analyst", "Mid-Senior level", "mid", "Semi", "Pleno", "Prácticas", "Intermedio",
    "Director", "No disponible", "nan", "", "N/A",
)
POSTED = (
    "2024-01-31", "2024-1-5", "2024-02-30", "2025-12-24", "2024-01-05T10:00:00", "Hace 5 horas", "3 hours ago",
    "Hace unas horas", "Hace 2 días", "8 days ago", "Hace 2 semanas", "hace 3 meses", "Hace 5 minutos", "1 semana",
    "2 weeks ago", "una semana", "1 mes", "2 months ago", "month", "No encontrado", "nan", "", "N/A", "ayer",
    "ahora mismo", "7 días", "HACE 8 DÍAS", "20240105", "hora 2 semana 3", "días 0", "2024-01-32",
)

RAW_LISTINGS = f"""
SELECT
  CASE WHEN l_partkey % 41 = 0 THEN '' WHEN l_partkey % 43 = 0 THEN 'N/A' WHEN l_partkey % 47 = 0 THEN 'abc'
       WHEN l_partkey % 53 = 0 THEN '  ' || p_name || '\n' || p_brand || '  '
       WHEN l_partkey % 59 = 0 THEN '  ' WHEN l_partkey % 61 = 0 THEN 'Desconocido'
       ELSE p_name || ' ' || p_brand END AS producto,
  CASE l_orderkey % 40
    WHEN 0 THEN 'N/A' WHEN 1 THEN '' WHEN 2 THEN 'No disponible' WHEN 3 THEN 'abc' WHEN 4 THEN '12d'
    WHEN 5 THEN '$1,234.56' WHEN 6 THEN '$1,234,567' WHEN 7 THEN ' ' || amount || ' ' WHEN 8 THEN '$ ' || amount
    WHEN 9 THEN '1e5' WHEN 10 THEN '-' || amount WHEN 11 THEN '$.5' WHEN 12 THEN '50000' WHEN 13 THEN '$100.000'
    WHEN 14 THEN '$500.000' WHEN 15 THEN '$ 50.250' ELSE '$' || amount END AS precio,
  CASE WHEN l_suppkey % 10 = 0 THEN 'N/A' WHEN l_suppkey % 11 = 0 THEN 'NO disponible'
       WHEN l_suppkey % 13 = 0 THEN 'Desconocido' ELSE s_name END AS vendedor,
  CASE WHEN l_suppkey % 4 = 0 THEN 'No disponible' ELSE 'Ciudad ' || CAST(s_nationkey AS VARCHAR(9)) END AS ubicacion,
  {_choice("(l_suppkey + l_linenumber)", REPUTATIONS)} AS reputacion_vendedor,
  CAST(CAST(l_shipdate AS DATE) AS VARCHAR(10)) AS fecha_extraccion,
  CASE WHEN l_orderkey % 10 = 3 THEN 'N/A' WHEN l_orderkey % 97 = 0 THEN ''
       ELSE 'https://articulos.example.com/p/' || CAST(l_partkey AS VARCHAR(19)) || '-' || CAST(l_suppkey % 5 AS VARCHAR(9))
            || '?t=' || CAST(l_linenumber % 2 AS VARCHAR(9)) || '#x' END AS url_producto,
  CASE WHEN l_linenumber = 7 THEN 'TRUE' WHEN l_returnflag = 'A' THEN 'Sí' WHEN l_returnflag = 'N' THEN 'si'
       WHEN l_linenumber = 6 THEN ' Sí' ELSE 'No' END AS disponible,
  CASE WHEN l_linenumber = 6 THEN 'Gratis' WHEN l_linenumber = 5 THEN '1' WHEN l_linenumber = 4 THEN ''
       WHEN l_linestatus = 'O' THEN 'Sí' ELSE 'No' END AS envio_gratis,
  CASE WHEN l_partkey % 67 = 0 THEN '' ELSE p_type END AS categoria,
  l_orderkey AS orden_1, l_linenumber AS orden_2, l_partkey AS orden_3, l_suppkey AS orden_4,
  l_extendedprice AS orden_5
FROM (
  SELECT *, CASE WHEN units >= 1000000 THEN
      CAST(CAST((units - units % 1000000) / 1000000 AS BIGINT) AS VARCHAR(19)) || '.'
      || lpad(CAST(CAST((units % 1000000 - units % 1000) / 1000 AS BIGINT) AS VARCHAR(19)), 3, '0')
    ELSE CAST(CAST((units - units % 1000) / 1000 AS BIGINT) AS VARCHAR(19)) END
    || '.' || lpad(CAST(units % 1000 AS VARCHAR(19)), 3, '0') || ',' || lpad(CAST(cents AS VARCHAR(19)), 2, '0') AS amount
  FROM (
    SELECT *, CAST(round(l_extendedprice * 10) AS BIGINT) AS units,
           CAST(round(l_extendedprice * 100) AS BIGINT) % 100 AS cents
    FROM {{lineitem}}
  ) AS priced
) AS l
JOIN {{part}} AS p ON l_partkey = p_partkey
JOIN {{supplier}} AS s ON l_suppkey = s_suppkey
"""

RAW_POSTINGS = f"""
SELECT
  CAST(event_id % 50 + 1 AS VARCHAR(19)) AS indice,
  CAST(CAST(ts AS DATE) AS VARCHAR(10)) AS fecha_extraccion,
  CASE WHEN event_id % 41 = 0 THEN 'ab' WHEN event_id % 43 = 0 THEN 'N/A' WHEN event_id % 47 = 0 THEN 'Sin información'
       ELSE event_type || ' engineer ' || CAST(user_id % 20 AS VARCHAR(19)) END AS titulo_puesto,
  CASE WHEN user_id % 37 = 0 THEN 'N/A' WHEN event_id % 59 = 0 THEN '' ELSE 'Company ' || CAST(user_id AS VARCHAR(19)) END
    AS empresa,
  {_choice("event_id", PLACES)} AS ubicacion,
  CASE WHEN event_id % 9 = 4 THEN 'No encontrado'
       ELSE 'https://empleos.example.com/v/' || CAST(user_id AS VARCHAR(19)) || '?k=' || event_type END AS url_empleo,
  {_choice("event_id", MODES)} AS modalidad,
  {_choice("event_id", POSTED)} AS fecha_publicacion,
  'Resumen ' || props || '...' AS descripcion_breve,
  {_choice("event_id", LEVELS)} AS nivel_experiencia,
  CASE WHEN event_id % 5 = 0 THEN 'Beneficios\r\nvarios ' ELSE 'No disponible' END AS beneficios_ofrecidos,
  event_type AS term, event_id AS pos
FROM {{events}}
"""

# Many detail rows per url, with different fetch times; a share of them holds only the sentinels.
LISTING_DETAILS = """
SELECT
  'https://articulos.example.com/p/' || CAST(l_partkey AS VARCHAR(19)) || '-' || CAST(l_suppkey % 5 AS VARCHAR(9))
    || '?t=' || CAST(l_linenumber % 2 AS VARCHAR(9)) || '#x' AS url,
  l_shipdate AS fetched_at,
  CASE WHEN l_orderkey % 2 = 0 THEN 'Desconocida' ELSE 'Barrio ' || CAST(l_orderkey AS VARCHAR(19)) END AS ubicacion,
  CASE WHEN l_orderkey % 3 = 0 THEN 'Desconocida' ELSE 'Nivel ' || CAST(l_orderkey AS VARCHAR(19)) END
    AS reputacion_vendedor
FROM {lineitem}
WHERE l_partkey % 3 <> 0
"""

POSTING_DETAILS = """
SELECT
  'https://empleos.example.com/v/' || CAST(user_id AS VARCHAR(19)) || '?k=' || event_type AS url,
  ts AS fetched_at,
  CASE WHEN event_id % 4 = 0 THEN 'No disponible' ELSE '  Detalle ' || repeat(props || ' ', 40) END AS descripcion_completa,
  CASE WHEN event_id % 3 = 0 THEN 'No disponible' ELSE 'Nivel ' || CAST(event_id AS VARCHAR(19)) END AS nivel_experiencia,
  CASE WHEN event_id % 2 = 0 THEN 'No disponible' ELSE 'Prepaga ' || CAST(event_id AS VARCHAR(19)) END
    AS beneficios_ofrecidos
FROM {events}
"""

LISTINGS_PER_TASK = 500_000
# Pages that one task renders: a result page has up to 50 cards, a detail page is a few lines.
RESULT_PAGES_PER_TASK = 2_000
DETAIL_PAGES_PER_TASK = 50_000

FILLER = "Texto de relleno para la ficha completa de esta oferta."

LISTING_PAGES = f"""
SELECT p_partkey AS page_id, concat('https://listado.example.com/', p_partkey) AS url, p_type AS term,
  concat('<html><head><title>Resultados</title></head><body><script>var x = "$";</script>',
    CASE WHEN p_partkey % 7 = 6 THEN '<ol><li class="ui-search-layout__item">corto</li></ol>' ELSE '' END,
    array_join(transform(sequence(1, p_size), i -> concat(
      CASE WHEN p_partkey % 7 < 5 THEN '<li class="ui-search-layout__item wide">'
           WHEN p_partkey % 7 = 5 THEN '<div data-testid="a-result-row">' ELSE '<div class="ui-search-results__item">' END,
      CASE (p_partkey + i) % 8
        WHEN 0 THEN concat('<h2><a class="poly-component__title" href="/p/', p_partkey, '-', i, '?a=1&amp;b=2">Modelo ', i,
          ' ', p_name, ' &amp; más</a></h2><span class="poly-component__seller"> Por ', p_brand,
          ' </span><span class="andes-money-amount__fraction">', p_partkey % 900 + 100, '.', i + 100,
          '</span><div class="poly-component__shipping">Envío gratis</div><img src="https://img.example.com/', p_partkey,
          '.jpg"><p>{FILLER}')
        WHEN 1 THEN concat('<div class="ui-search-item__title"><a href="https://otra.example.com/', p_partkey, '/', i,
          '">Artículo ', i, '\n  ', p_name, '</a></div><div class="ui-search-item__seller-info">', p_brand,
          '</div><span class="price-tag-fraction">', i, '</span><img src="/local.png"><span>Precio en pesos. {FILLER}</span>')
        WHEN 2 THEN concat('<a class="poly-component__title" href="/p/2">Sin importe ', p_name,
          '</a> precio a convenir {FILLER}')
        WHEN 3 THEN '<a class="poly-component__title" href="/p/3">abc</a><span class="price-tag-fraction">7</span>$ {FILLER}'
        WHEN 4 THEN concat('<a class="poly-component__title" href="/p/4">Modelo ', p_name,
          '</a><span class="price-tag-fraction">8</span> {FILLER}')
        WHEN 5 THEN '<a class="poly-component__title" href="/x">Mini $ 5</a><span class="price-tag-fraction">5</span>'
        WHEN 6 THEN concat('<a class="poly-component__title" href="ftp://x"> </a><div class="ui-search-item__title">',
          '<a href="mailto:x">Segundo ', i, ' <b>', p_name, '</b></a></div><span class="andes-money-amount__fraction"> ',
          '</span><span class="price-tag-fraction">9', i, '</span>ENVÍO por correo. {FILLER}')
        ELSE concat('<h2><a href="/q/', p_partkey, '">Título ', p_name, ' ', i,
          '</a></h2><span class="andes-money-amount__fraction">77</span> $ {FILLER}')
      END,
      CASE WHEN p_partkey % 7 < 5 THEN '</li>' ELSE '</div>' END)), ''),
    '</body></html>') AS html
FROM {{part}}
"""

POSTING_PAGES = """
SELECT c_custkey AS page_id, concat('https://busqueda.example.com/', c_custkey) AS url, c_mktsegment AS term,
  concat('<html><body>', CASE WHEN c_custkey % 4 < 2 THEN '<ul>' ELSE '<ol>' END,
    array_join(transform(sequence(1, CAST(1 + c_custkey % 9 AS INT)), i -> concat(
      CASE WHEN c_custkey % 4 = 2 THEN concat('<li data-occludable-job-id="', i, '">') ELSE '<li>' END,
      CASE (c_custkey + i) % 6
        WHEN 0 THEN concat('<div><a href="/jobs/view/', c_custkey, '-', i, '?trk=a"><span><strong> Data Engineer ', i,
          ' </strong></span></a></div><div><span dir="ltr">Empresa ', c_name,
          '</span></div><div><span dir="ltr">Buenos Aires,\n   Argentina (Híbrido)</span></div><time datetime="2024-01-',
          lpad(CAST(i AS STRING), 2, '0'), '">hace 3 días</time><p class="job-search-card__snippet">',
          repeat(concat(c_name, ' busca '), 20), '</p>')
        WHEN 1 THEN concat('<a href="https://otra.example.com/jobs/view/', c_custkey, '">Analista ', c_mktsegment,
          '</a><span dir="ltr">Ciudad de Córdoba (En remoto)</span><span dir="ltr">ACME ', c_nationkey,
          '</span><time>Hace 2 semanas</time>')
        WHEN 2 THEN '<a href="/jobs/view/2">Sin empresa</a><span dir="ltr">Argentina</span>'
        WHEN 3 THEN concat('<a href="/jobs/view/9"><strong>Dev ', i, '</strong></a><span dir="ltr">Beta SA</span><ul><li>',
          '<span dir="ltr">Presencial en provincia ', c_nationkey, '</span></li></ul><span>Publicado Hace ', i,
          ' días</span><div>Descripción: tareas varias</div>')
        WHEN 4 THEN '<a href="/jobs/view/5"> </a><span dir="ltr">Delta</span>'
        ELSE concat('<a href="/jobs/view/', c_custkey, '/', i, '"><span>Rol ', i,
          '</span></a><span dir="ltr"> Gamma </span><time datetime="">ayer</time>')
      END, '</li>')), ''),
    CASE WHEN c_custkey % 4 < 2 THEN '</ul>' ELSE '</ol>' END, '</body></html>') AS html
FROM {customer}
"""

LISTING_DETAIL_PAGES = """
SELECT o_orderkey AS page_id, concat('https://articulos.example.com/o/', o_orderkey) AS url, o_orderdate AS fetched_at,
  concat('<html><body>',
    CASE o_orderkey % 4
      WHEN 0 THEN concat('<h1 class="ui-pdp-title">Orden ', o_orderkey, '</h1><span class="ui-pdp-subtitle">Nuevo</span>',
        '<span class="andes-money-amount__fraction">', CAST(o_totalprice AS BIGINT), '</span>',
        '<a class="ui-pdp-seller__header__title">Tienda ', o_custkey, '</a><div class="ui-seller-info">',
        '<div class="ui-seller-info__header__title">Vendedor</div><div><p><span>Reputación ', o_orderstatus,
        '</span></div></div><div class="ui-seller-info__status-info__subtitle">Ciudad ', o_custkey % 25, '</div>')
      WHEN 1 THEN concat('<h1 class="ui-pdp-title">Orden ', o_orderkey, '<br>segunda línea</h1>',
        '<p class="ui-seller-info__status-info__title">Verde ', o_orderpriority, '</p>',
        '<span class="ui-seller-location">Barrio ', o_custkey % 9, '</span>')
      WHEN 2 THEN '<p>Publicación pausada</p>'
      ELSE concat('<h1 class="ui-pdp-title">N/A</h1><span class="ui-pdp-subtitle"> </span>',
        '<span class="andes-money-amount__fraction">', o_custkey, '</span>') END,
    '</body></html>') AS html
FROM {orders}
"""

POSTING_DETAIL_PAGES = """
SELECT event_id AS page_id, concat('https://empleos.example.com/e/', event_id) AS url, ts AS fetched_at,
  concat('<html><body>',
    CASE event_id % 5
      WHEN 0 THEN concat('<div class="jobs-box__html-content"> Tareas de ', event_type, ' </div>',
        '<span dir="ltr" class="job-details-jobs-unified-top-card__job-insight-view-model-secondary">Jornada completa</span>',
        '<span dir="ltr" class="job-details-jobs-unified-top-card__job-insight-view-model-secondary">"Intermedio"\n',
        '  de ', event_type, '</span>')
      WHEN 1 THEN concat('<div class="description__text">Texto ', user_id, '</div>',
        '<li class="jobs-unified-top-card__job-insight">Senior level</li>',
        '<li class="jobs-unified-top-card__job-insight">Con BENEFICIOS ', user_id, '</li>')
      WHEN 2 THEN '<div class="jobs-description-content__text"> </div><div class="jobs-benefits">Prepaga</div>'
      WHEN 3 THEN '<p>Aviso cerrado</p>'
      ELSE concat('<p class="other job-insight-view-model-secondary">x</p><span dir="ltr" class="a-job-insight-view-model-',
        'secondary">Director ', user_id, '</span><div class="jobs-description-content__text">Uno<br>Dos</div>') END,
    '</body></html>') AS html
FROM {events}
"""


DERIVED: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
# Derived tables that a benchmark has written beforehand, by folder and name; empty otherwise.
PREPARED: dict[tuple[str, str], DataFrame] = {}


def derived(function):
    DERIVED[function.__name__] = function

    @wraps(function)
    def get(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = PREPARED.get((sf_dir, function.__name__))
        return function(spark, sf_dir) if found is None else found

    return get


def prepare(spark: SparkSession, sf_dir: str, names: Sequence[str], files: int) -> None:
    """Write derived tables in several files each, so that a benchmark times operators apart from deriving their rows."""
    for name in names:
        PREPARED[sf_dir, name] = staging.stage_table(DERIVED[name](spark, sf_dir).repartition(files))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def derive(spark: SparkSession, sf_dir: str, text: str, *names: str) -> DataFrame:
    return spark.sql(text, **{name: table(spark, sf_dir, name) for name in names})


def render(spark: SparkSession, sf_dir: str, text: str, name: str, rows_per_task: int) -> DataFrame:
    """Pages rendered from the rows of a table, in tasks that grow in number with the rows.

    The narrow rows of a table fit in a few megabytes, so one task would read them all, render the pages, which are many times as
    large, and parse them. The rows are dealt out before they are rendered: only they are shuffled, no HTML.
    """
    rows = table(spark, sf_dir, name)
    return spark.sql(text, **{name: rows.repartition(max(1, -(-rows.count() // rows_per_task)))})


@derived
def result_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_source.scan_pages(spark, f"{sf_dir}/pages.parquet")


@derived
def raw_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listings in tasks of bounded rows.

    A listing is several times as wide as the row it comes from, so tasks cut by the bytes of their input would sort and spill too
    much. The narrow rows are dealt out by the key they are joined on: a join that shuffles finds them in place.
    """
    rows = table(spark, sf_dir, "lineitem")
    tasks = -(-rows.count() // LISTINGS_PER_TASK)
    if tasks > 1:
        rows = rows.repartition(tasks, "l_partkey")
    return spark.sql(RAW_LISTINGS, lineitem=rows, **{name: table(spark, sf_dir, name) for name in ("part", "supplier")})


@derived
def raw_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive(spark, sf_dir, RAW_POSTINGS, "events")


@derived
def listing_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive(spark, sf_dir, LISTING_DETAILS, "lineitem")


@derived
def posting_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive(spark, sf_dir, POSTING_DETAILS, "events")


@derived
def listing_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render(spark, sf_dir, LISTING_PAGES, "part", RESULT_PAGES_PER_TASK)


@derived
def posting_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render(spark, sf_dir, POSTING_PAGES, "customer", RESULT_PAGES_PER_TASK)


@derived
def listing_detail_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render(spark, sf_dir, LISTING_DETAIL_PAGES, "orders", DETAIL_PAGES_PER_TASK)


@derived
def posting_detail_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render(spark, sf_dir, POSTING_DETAIL_PAGES, "events", DETAIL_PAGES_PER_TASK)
