"""Plain SQL for the registered queries, written apart from the library and run by DuckDB on the same tables."""

from __future__ import annotations

from checks import sample_tables as st
from vitrina import fixed_values as fv

ORACLE: dict[str, str] = {}

_TABLES = {name: name for name in ("lineitem", "part", "supplier", "events", "customer", "orders")}


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _in(texts) -> str:
    return "(" + ", ".join(_q(text) for text in texts) + ")"


WS = _q(fv.WHITESPACE)
NA = _in(fv.NA_TOKENS)
AS_OF = f"TIMESTAMP '{st.AS_OF}'"


def _strip(expr: str) -> str:
    return f"trim({expr}, {WS})"


def _has(expr: str, *words: str) -> str:
    return "(" + " OR ".join(f"contains({expr}, {_q(word)})" for word in words) + ")"


def _cents(expr: str) -> str:
    return f"round_even(CAST({expr} AS DOUBLE) * 100, 0) / 100"


def _na(names) -> str:
    return ", ".join(f"CASE WHEN {name} NOT IN {NA} THEN {name} END AS {name}" for name in names)


LISTING_ORDER = ", ".join(st.LISTING_ORDER)
RAW_L = f"raw AS ({st.RAW_LISTINGS.format(**_TABLES)})"
RAW_P = f"rawp AS ({st.RAW_POSTINGS.format(**_TABLES)})"

NUMBER = _strip("replace(replace(replace(replace(precio, '$', ''), ' ', ''), '.', ''), ',', '.')")
LISTINGS = f"""
{RAW_L},
known AS (SELECT {_na(fv.LISTING_COLUMNS)}, {LISTING_ORDER} FROM raw),
typed AS (
  SELECT *,
    CASE WHEN precio IS NULL OR lower(precio) IN ('no disponible', 'nan') THEN 0.0::DOUBLE
      WHEN regexp_full_match({NUMBER}, '[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?')
        THEN coalesce(TRY_CAST({NUMBER} AS DOUBLE), 0) ELSE 0 END AS precio_numerico,
    CASE WHEN vendedor IS NULL OR lower(vendedor) = 'no disponible' THEN 'Vendedor no especificado' ELSE vendedor END
      AS vendedor_limpio,
    CASE WHEN reputacion_vendedor IS NULL OR lower(reputacion_vendedor) = 'no disponible' THEN 'Sin información de reputación'
      WHEN {_has("lower(reputacion_vendedor)", "verde", "buena", "excelente")} THEN 'Buena reputación'
      WHEN {_has("lower(reputacion_vendedor)", "amarilla", "regular")} THEN 'Reputación regular'
      WHEN {_has("lower(reputacion_vendedor)", "roja", "mala")} THEN 'Mala reputación'
      WHEN {_has("lower(reputacion_vendedor)", "nuevo", "sin reputación")} THEN 'Vendedor nuevo'
      ELSE 'Sin información de reputación' END AS reputacion_limpia,
    coalesce(lower(disponible) IN ('sí', 'si', 'true', '1', 'disponible'), false) AS disponible_bool,
    coalesce(lower(envio_gratis) IN ('sí', 'si', 'true', '1', 'gratis'), false) AS envio_gratis_bool
  FROM known
),
scored AS (
  SELECT *,
    CASE WHEN precio_numerico < 100000 THEN 'Bajo' WHEN precio_numerico <= 500000 THEN 'Medio' ELSE 'Alto' END AS rango_precio,
    CASE reputacion_limpia WHEN 'Buena reputación' THEN 4 WHEN 'Reputación regular' THEN 2 WHEN 'Vendedor nuevo' THEN 1 ELSE 0 END
      + CASE WHEN disponible_bool THEN 2 ELSE 0 END + CASE WHEN envio_gratis_bool THEN 1 ELSE 0 END
      + CASE WHEN precio_numerico <= 0 THEN 0.0::DOUBLE
          WHEN precio_numerico < 100000 THEN greatest(0.0::DOUBLE, 3.0::DOUBLE - precio_numerico / 50000.0::DOUBLE)
          WHEN precio_numerico <= 500000
            THEN greatest(0.0::DOUBLE, 2.0::DOUBLE - (precio_numerico - 100000.0::DOUBLE) / 200000.0::DOUBLE)
          ELSE greatest(0.0::DOUBLE, 1.0::DOUBLE - (precio_numerico - 500000.0::DOUBLE) / 500000.0::DOUBLE) END AS score
  FROM typed
),
listings AS (SELECT * EXCLUDE (score), CAST(printf('%.2f', score) AS DOUBLE) AS puntaje_valor FROM scored)
"""

FP = "lower(fecha_publicacion)"


def _posted(source: str, lowered: str, units) -> str:
    hours = " ".join(f"WHEN {_has(lowered, *words)} THEN {value}" for words, value in units)
    amount = f"TRY_CAST(regexp_extract({lowered}, '[0-9]+') AS BIGINT)"
    span = f"(CAST({amount} AS HUGEINT) * (CASE {hours} END))"
    return f"""CASE
      WHEN {source} IS NULL OR {lowered} IN ('no encontrado', 'nan') THEN {AS_OF} - INTERVAL 12 HOUR
      WHEN regexp_full_match({source}, '[0-9]{{4}}-[0-9]{{1,2}}-[0-9]{{1,2}}')
        AND try_strptime({source}, '%Y-%m-%d') IS NOT NULL THEN try_strptime({source}, '%Y-%m-%d')
      WHEN {span} <= date_diff('hour', TIMESTAMP '0001-01-01 00:00:00', {AS_OF}) THEN {AS_OF} - to_hours(CAST({span} AS INTEGER))
      ELSE {AS_OF} - INTERVAL 12 HOUR END"""


UNITS = ((("hora", "hour"), 1), (("día", "day", "hace"), 24), (("semana", "week"), 168), (("mes", "month"), 720))
STRICT = (UNITS[0], UNITS[2], UNITS[3], UNITS[1])
LEVEL, MODE = "lower(nivel_experiencia)", "lower(modalidad)"


def _title(expr: str) -> str:
    runs = f"regexp_extract_all({expr}, '(\\p{{L}}+|\\P{{L}}+)')"
    # DuckDB leaves a leading ß as it is; its title form is Ss.
    first = "CASE WHEN s[1:1] = 'ß' THEN 'Ss' ELSE upper(s[1:1]) END"
    return f"array_to_string(list_transform({runs}, lambda s: {first} || s[2:]), '')"


def _age(moment: str) -> str:
    days = f"floor((epoch_us({AS_OF}) - epoch_us({moment})) / 86400000000.0)"
    return f"CASE WHEN {days} = 0 THEN 'Últimas 24 horas' WHEN {days} <= 7 THEN 'Última semana' ELSE 'Más de una semana' END"


def _postings(units=UNITS) -> str:
    return f"""
{RAW_P},
knownp AS (SELECT {_na(fv.POSTING_COLUMNS)}, term, pos FROM rawp),
dated AS (
  SELECT *, {_posted("fecha_publicacion", FP, units)} AS fecha_publicacion_dt,
    CASE WHEN nivel_experiencia IS NULL OR {LEVEL} IN ('no disponible', 'nan') THEN 'No especificado'
      WHEN {_has(LEVEL, "desenvolvedor", "developer")} THEN
        CASE WHEN {_has(LEVEL, "senior", "sr")} THEN 'Senior level' WHEN {_has(LEVEL, "junior", "jr")} THEN 'Entry level'
          ELSE 'Mid level' END
      WHEN {_has(LEVEL, "entry", "junior", "trainee")} THEN 'Entry level'
      WHEN {_has(LEVEL, "senior", "sr")} THEN 'Senior level'
      WHEN {_has(LEVEL, "mid", "semi", "pleno")} THEN 'Mid level' ELSE 'No especificado' END AS nivel_experiencia_limpio,
    CASE WHEN modalidad IS NULL OR {MODE} = 'no disponible' THEN 'No especificado'
      WHEN {_has(MODE, "remoto", "remote")} THEN 'Remoto'
      WHEN {_has(MODE, "presencial", "on-site", "oficina")} THEN 'Presencial'
      WHEN {_has(MODE, "híbrido", "hybrid")} THEN 'Híbrido' ELSE {_title(MODE)} END AS modalidad_limpia
  FROM knownp
),
postings AS (SELECT *, {_age("fecha_publicacion_dt")} AS categoria_fecha FROM dated)
"""


POSTINGS = _postings()


def _number_terms() -> str:
    arms = " ".join(f"WHEN '{term}' THEN {no}" for no, term in enumerate(st.POSTING_TERMS))
    return f"numbered AS (SELECT *, CASE term {arms} END AS term_no FROM rawp)"


# --- scans, sources, sinks -----------------------------------------------------------------------------------------------

ORACLE["scan_listings"] = f"WITH {RAW_L} SELECT {_na(fv.LISTING_COLUMNS)} FROM raw"
ORACLE["ingest_new_snapshots"] = f"""
WITH {RAW_L} SELECT {_na(fv.LISTING_COLUMNS)}, 'listings_' || ({st.LISTING_ORDER[1]} % 3) AS snapshot FROM raw"""
ORACLE["scan_listings_reordered"] = ORACLE["scan_listings"]
ORACLE["scan_listings_one_file"] = f"""
WITH whole AS ({st.RAW_LISTINGS.format(**_TABLES)}), raw AS (SELECT * REPLACE (CASE WHEN {st.LISTING_ORDER[1]} % 2 = 0
  THEN producto || chr(10) || '"línea"' || chr(10) || categoria ELSE producto END AS producto) FROM whole)
SELECT {_na(fv.LISTING_COLUMNS)} FROM raw"""
ORACLE["scan_postings"] = f"WITH {RAW_P} SELECT {_na(fv.POSTING_COLUMNS)} FROM rawp"
ORACLE["latest_snapshot"] = f"""
WITH {LISTINGS} SELECT categoria, count(*) AS n, 'listings_1.csv' AS snapshot FROM known GROUP BY categoria"""


def _clean(name: str, sentinels) -> str:
    return f"""CASE WHEN {name} IS NULL OR {name} = '' OR {name} IN {_in(sentinels)} THEN 'No disponible'
      ELSE replace(replace({_strip(name)}, chr(10), ' '), chr(13), ' ') END AS {name}"""


PRICE_TEXT = f"""CASE WHEN precio IS NULL OR precio IN ('', 'N/A') THEN 'Precio no disponible'
  WHEN starts_with(precio, '$') THEN {_strip("precio")} ELSE '$' || {_strip("precio")} END"""
_LISTING_TEXTS = {"producto", "vendedor", "ubicacion", "reputacion_vendedor", "categoria"}
CLEAN_L = "cleanl AS (SELECT " + ", ".join(
    _clean(n, ("N/A", "Desconocido")) if n in _LISTING_TEXTS else f"{PRICE_TEXT} AS precio" if n == "precio" else n
    for n in fv.LISTING_COLUMNS
) + " FROM raw)"
CLEAN_P = "cleanp AS (SELECT " + ", ".join(
    n if n in ("indice", "fecha_extraccion", "url_empleo") else _clean(n, ("N/A", "Desconocido", "Sin información"))
    for n in fv.POSTING_COLUMNS
) + " FROM rawp)"
VALID_L = """producto NOT IN ('', 'No disponible') AND precio NOT IN ('', 'Precio no disponible') AND length(producto) >= 5"""
VALID_P = """titulo_puesto NOT IN ('', 'No disponible') AND length(titulo_puesto) >= 3 AND empresa NOT IN ('', 'No disponible')"""

# A CSV field that is empty comes back as NULL from the plain read of the exported file.
ORACLE["export_listings"] = f"""
WITH {RAW_L}, {CLEAN_L} SELECT * REPLACE (nullif(url_producto, '') AS url_producto, nullif(disponible, '') AS disponible,
  nullif(envio_gratis, '') AS envio_gratis) FROM cleanl WHERE {VALID_L}"""
ORACLE["export_postings"] = f"WITH {RAW_P}, {CLEAN_P} SELECT * FROM cleanp WHERE {VALID_P}"

ORACLE["scan_pages"] = "SELECT page_id, url, html FROM pages"

# --- extraction from pages -----------------------------------------------------------------------------------------------


def _unescape(expr: str) -> str:
    for name, char in (("&copy;", "©"), ("&middot;", "·"), ("&quot;", '"'), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        expr = f"replace({expr}, '{name}', '{char}')"
    return expr


def _untag(expr: str) -> str:
    return _unescape(f"regexp_replace(regexp_replace({expr}, '<!--.*?-->', '', 'gs'), '<[^>]*>', '', 'g')")


NAV = "regexp_extract(html, '<nav>(.*?)</nav>', 1, 's')"
CONTAINERS = f"""
WITH items AS (SELECT page_id, unnest(regexp_extract_all({NAV}, '<li>(.*?)</li>', 1)) AS item,
  unnest(range(1, len(regexp_extract_all({NAV}, '<li>(.*?)</li>', 1)) + 1)) AS pos FROM pages)
SELECT page_id, CAST(pos AS INTEGER) AS pos, {_untag("item")} AS content FROM items"""
ORACLE["extract_containers"] = CONTAINERS
ORACLE["extract_containers_capped"] = f"{CONTAINERS} WHERE pos <= 4"
FILTERED = f"""
WITH parts AS (
  SELECT page_id, unnest(string_split(regexp_extract(html, '<article>(.*?)</article>', 1, 's'), '<p>')[2:]) AS part,
    unnest(range(1, len(string_split(regexp_extract(html, '<article>(.*?)</article>', 1, 's'), '<p>')))) AS pos
  FROM pages),
texts AS (SELECT page_id, CAST(pos AS INTEGER) AS pos, {_untag("string_split(part, '</p>')[1]")} AS content FROM parts)
SELECT * FROM texts WHERE length({_strip("content")}) > 50 AND {_has("lower(content)", "$", "precio", "envío")}"""
ORACLE["container_text_filter"] = FILTERED
ORACLE["container_text_filter_capped"] = f"{FILTERED} AND pos <= 20"
ORACLE["listing_block_text"] = f"""
SELECT doc_id, length({_strip("text")}) > 50 AND {_has("lower(text)", "$", "precio", "envío")} AS usable FROM documents"""
ORACLE["first_match_text"] = f"""
SELECT page_id, {_strip(_unescape("regexp_replace(regexp_extract(html, '<title>(.*?)</title>', 1, 's'), ' +', ' ', 'g')"))}
  AS text FROM pages"""
ORACLE["attribute_extract"] = f"""
SELECT page_id, {_unescape(f"regexp_extract({NAV}, '<a href=\"([^\"]*)\"', 1)")} AS value FROM pages"""
ORACLE["presence_flag"] = f"""
SELECT page_id, CASE WHEN contains(html, '<time') OR regexp_matches({NAV}, '<a href="[^"]*tion') THEN 'Sí' ELSE 'No' END AS flag
FROM pages"""

ALL_CARDS = f"""
cards AS (SELECT *, (p_partkey + i) % 8 AS k FROM (SELECT *, unnest(range(1, p_size + 1)) AS i FROM part)),
extracted AS (
  SELECT p_partkey AS page_id, CAST(i AS INTEGER) AS pos,
    CASE k WHEN 0 THEN 'Modelo ' || i || ' ' || p_name || ' & más' WHEN 1 THEN 'Artículo ' || i || ' ' || p_name
      WHEN 6 THEN 'Segundo ' || i || ' ' || p_name ELSE 'Título ' || p_name || ' ' || i END AS producto,
    CASE k WHEN 0 THEN '$' || (p_partkey % 900 + 100) || '.' || (i + 100) WHEN 1 THEN '$' || i WHEN 6 THEN '$9' || i ELSE '$77' END
      AS precio,
    CASE k WHEN 0 THEN 'Por ' || p_brand WHEN 1 THEN p_brand ELSE 'N/A' END AS vendedor,
    '' AS ubicacion, '' AS reputacion_vendedor, '2024-02-01' AS fecha_extraccion,
    CASE k WHEN 0 THEN '{st.LISTING_HOST}/p/' || p_partkey || '-' || i || '?a=1&b=2'
      WHEN 1 THEN 'https://otra.example.com/' || p_partkey || '/' || i ELSE 'N/A' END AS url_producto,
    'Sí' AS disponible, CASE WHEN k = 0 THEN 'Sí' ELSE 'No' END AS envio_gratis, p_type AS categoria,
    CASE WHEN k = 0 THEN 'https://img.example.com/' || p_partkey || '.jpg' ELSE 'N/A' END AS imagen_url, '' AS condicion
  FROM cards WHERE k IN (0, 1, 6, 7)
)"""
ORACLE["extract_listings"] = f"WITH {ALL_CARDS} SELECT * FROM extracted"
ORACLE["extract_listings_capped"] = f"WITH {ALL_CARDS} SELECT * FROM extracted WHERE pos <= 20"


def _listing_session(block: str, row: str) -> str:
    return f"""
WITH {ALL_CARDS},
numbered AS (SELECT *, list_position({list(st.LISTING_TERMS)}, categoria) AS term_no,
  row_number() OVER (PARTITION BY categoria ORDER BY page_id, pos) AS rn FROM extracted
  WHERE {block} AND categoria IN {_in(st.LISTING_TERMS)}),
capped AS (SELECT *, CASE WHEN url_producto <> 'N/A' THEN url_producto ELSE producto || '_' || precio || '_' || vendedor END AS k
  FROM numbered WHERE {row})
SELECT 'listings' AS kind, count(*) AS rows_extracted, count(DISTINCT k) AS rows_unique,
  count(*) - count(DISTINCT k) AS duplicates_dropped, count(DISTINCT k) AS rows_valid, true AS success FROM capped"""


ORACLE["run_listing_session"] = _listing_session("true", "true")
ORACLE["run_listing_session_capped"] = _listing_session("pos <= 20", "rn <= 50")

POSTED_CARDS = f"""
cards AS (
  SELECT *, (c_custkey + i) % 6 AS k FROM (SELECT *, unnest(range(1, CAST(2 + c_custkey % 9 AS INTEGER))) AS i FROM customer)
),
extracted AS (SELECT c_custkey AS page_id, CAST(i AS INTEGER) AS pos, c_mktsegment AS term, CAST(i AS INTEGER) AS indice,
  '2024-02-01' AS fecha_extraccion,
  CASE k WHEN 0 THEN 'Data Engineer ' || i WHEN 1 THEN 'Analista ' || c_mktsegment WHEN 3 THEN 'Dev ' || i ELSE 'Rol ' || i END
    AS titulo_puesto,
  CASE k WHEN 0 THEN 'Empresa ' || c_name WHEN 1 THEN 'ACME ' || c_nationkey WHEN 3 THEN 'Beta SA' ELSE 'Gamma' END AS empresa,
  CASE k WHEN 0 THEN 'Buenos Aires, Argentina (Híbrido)' WHEN 3 THEN 'Presencial en provincia ' || c_nationkey
    ELSE 'No encontrado' END AS ubicacion,
  CASE k WHEN 0 THEN '{st.POSTING_HOST}/jobs/view/' || c_custkey || '-' || i || '?trk=a'
    WHEN 1 THEN 'https://otra.example.com/jobs/view/' || c_custkey WHEN 3 THEN '{st.POSTING_HOST}/jobs/view/9'
    ELSE '{st.POSTING_HOST}/jobs/view/' || c_custkey || '/' || i END AS url_empleo,
  CASE k WHEN 0 THEN 'Híbrido' WHEN 3 THEN 'Presencial' ELSE 'No encontrado' END AS modalidad,
  CASE k WHEN 0 THEN '2024-01-' || lpad(CAST(i AS VARCHAR), 2, '0') WHEN 1 THEN 'Hace 2 semanas'
    WHEN 3 THEN 'Publicado Hace ' || i || ' días' ELSE 'No encontrado' END AS fecha_publicacion,
  CASE k WHEN 0 THEN substring(trim(repeat(c_name || ' busca ', 20)), 1, 200) || '...'
    WHEN 3 THEN 'Descripción: tareas varias...' ELSE 'No disponible' END AS descripcion_breve,
  'No disponible' AS nivel_experiencia, 'No disponible' AS beneficios_ofrecidos
FROM cards WHERE k IN (0, 1, 3, 5))"""
ORACLE["extract_postings"] = f"WITH {POSTED_CARDS} SELECT * FROM extracted"
ORACLE["extract_postings_capped"] = ORACLE["extract_postings"]  # no page has 50 cards


def _posting_session(row: str) -> str:
    return f"""
WITH {POSTED_CARDS},
ranked AS (SELECT *, row_number() OVER (PARTITION BY term ORDER BY page_id, pos) AS rn FROM extracted
  WHERE term IN {_in(st.SEGMENTS)}),
capped AS (SELECT * FROM ranked WHERE {row})
SELECT 'postings' AS kind, count(*) AS rows_extracted, count(DISTINCT url_empleo) AS rows_unique,
  count(*) - count(DISTINCT url_empleo) AS duplicates_dropped, count(DISTINCT url_empleo) AS rows_valid, true AS success FROM capped"""


ORACLE["run_posting_session"] = _posting_session("true")
ORACLE["run_posting_session_capped"] = _posting_session("rn <= 50")

def _session_counts(kind: str, cards: str, table: str, term: str, terms, key: str, bare: str = "0") -> str:
    """Sessions without caps, with the web pages beside the rendered ones, of which `bare` hold no record and little text."""
    return f"""
WITH {cards},
ranked AS (SELECT *, list_position({list(terms)}, {term}) AS term_no FROM extracted WHERE {term} IN {_in(terms)}),
firsts AS (SELECT * FROM (SELECT *, {key} AS k FROM ranked) QUALIFY row_number() OVER (PARTITION BY k ORDER BY term_no, page_id, pos) = 1),
bodies AS (SELECT page_id, {_untag("regexp_extract(html, '<body>(.*)', 1, 's')")} AS body FROM pages),
statuses AS (SELECT {_status("body")} FROM bodies),
listed AS (SELECT {term} AS name, count(*) AS n FROM firsts GROUP BY {term})
SELECT '{kind}' AS kind, (SELECT count(*) FROM {table}) + (SELECT count(*) FROM pages) AS pages,
  (SELECT count(*) FROM statuses WHERE status = 'blocked') AS pages_blocked, (SELECT count(*) FROM statuses WHERE status = 'thin') + {bare} AS pages_thin,
  (SELECT count(*) FROM extracted WHERE {term} NOT IN {_in(terms)}) AS rows_other_terms, (SELECT count(*) FROM ranked) AS rows_extracted,
  (SELECT count(*) FROM firsts) AS rows_unique, (SELECT count(*) FROM firsts) AS rows_valid, true AS success, CAST(NULL AS VARCHAR) AS error,
  (SELECT string_agg(name || '=' || n, ';' ORDER BY name) FROM listed) AS categories"""


HREFS = "regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1)"
ORACLE["absolutize_url"] = f"""
WITH links AS (SELECT page_id, unnest({HREFS}) AS raw_href, unnest(range(0, len({HREFS}))) AS pos FROM pages),
hrefs AS (SELECT page_id, CAST(pos AS INTEGER) AS pos, {_unescape("raw_href")} AS href FROM links)
SELECT *, CASE WHEN starts_with(href, '/') THEN '{st.LISTING_HOST}' || href WHEN starts_with(href, 'http') THEN href END AS listing_url,
  CASE WHEN starts_with(href, 'http') THEN href WHEN href <> '' THEN '{st.POSTING_HOST}' || href END AS posting_url FROM hrefs"""


def _located(expr: str) -> str:
    return _has(f"lower({expr})", "argentina", "buenos aires", "comuna", "remoto", "híbrido", "presencial", "provincia", "ciudad")


ORACLE["company_pick"] = f"""
WITH {RAW_P} SELECT pos, coalesce(
  CASE WHEN {_strip("ubicacion")} <> '' AND NOT {_located("ubicacion")} THEN {_strip("ubicacion")} END,
  CASE WHEN {_strip("modalidad")} <> '' AND NOT {_located("modalidad")} THEN {_strip("modalidad")} END,
  CASE WHEN {_strip("empresa")} <> '' AND NOT {_located("empresa")} THEN {_strip("empresa")} END,
  'No encontrado') AS empresa_elegida FROM rawp"""
ORACLE["location_predicate"] = f"""
WITH {RAW_P}, texts AS (SELECT doc_id AS id, text FROM documents UNION ALL SELECT pos, ubicacion FROM rawp)
SELECT id, {_located("text")} AS is_location FROM texts"""
ORACLE["location_and_mode"] = f"""
WITH {RAW_P}, places AS (SELECT pos, ubicacion || chr(10) || ' ' || chr(9) || modalidad AS place FROM rawp)
SELECT pos, CASE WHEN {_located("place")} THEN regexp_replace({_strip("place")}, '\\s+', ' ', 'g') ELSE 'No encontrado' END AS ubicacion,
  CASE WHEN NOT {_located("place")} THEN 'No encontrado' WHEN contains(lower(place), 'híbrido') THEN 'Híbrido'
    WHEN contains(lower(place), 'remoto') THEN 'Remoto' WHEN contains(lower(place), 'presencial') THEN 'Presencial'
    ELSE 'No encontrado' END AS modalidad FROM places"""
ORACLE["snippet"] = f"SELECT doc_id, substring({_strip('text')}, 1, 200) || '...' AS snippet FROM documents"
ORACLE["posting_detail"] = f"""
SELECT '{st.POSTING_HOST}/e/' || event_id AS url, ts AS fetched_at,
  CASE event_id % 5 WHEN 0 THEN 'Tareas de ' || event_type WHEN 1 THEN 'Texto ' || user_id WHEN 4 THEN 'Uno' || chr(10) || 'Dos'
    ELSE 'No disponible' END AS descripcion_completa,
  CASE event_id % 5 WHEN 0 THEN 'Intermedio de ' || event_type WHEN 1 THEN 'Senior level' WHEN 4 THEN 'Director ' || user_id
    ELSE 'No disponible' END AS nivel_experiencia,
  CASE event_id % 5 WHEN 1 THEN 'Con BENEFICIOS ' || user_id WHEN 2 THEN 'Prepaga' ELSE 'No disponible' END AS beneficios_ofrecidos
FROM events"""
_LEVELLED = [
    "modalidad",
    "trim(replace(replace(' \"' || nivel_experiencia || '\"' || ' de ''planta'' ', '\"', ''), '''', ''))",
    "titulo_puesto",
]
ORACLE["level_pick"] = f"""
WITH {RAW_P} SELECT pos, coalesce(""" + ", ".join(
    f"CASE WHEN {_has(f'lower({c})', *fv.LEVEL_WORDS)} THEN regexp_replace({c}, ' +', ' ', 'g') END" for c in _LEVELLED
) + ", 'No disponible') AS nivel FROM rawp"
ORACLE["listing_detail"] = f"""
SELECT '{st.LISTING_HOST}/o/' || o_orderkey AS url,
  CASE o_orderkey % 4 WHEN 0 THEN 'Orden ' || o_orderkey WHEN 1 THEN 'Orden ' || o_orderkey || chr(10) || 'segunda línea'
    ELSE 'No disponible' END AS titulo,
  CASE o_orderkey % 4 WHEN 0 THEN CAST(CAST(trunc(o_totalprice) AS BIGINT) AS VARCHAR) WHEN 3 THEN CAST(o_custkey AS VARCHAR)
    ELSE 'No disponible' END AS precio,
  CASE o_orderkey % 4 WHEN 0 THEN 'Tienda ' || o_custkey ELSE 'No disponible' END AS vendedor,
  CASE o_orderkey % 4 WHEN 0 THEN 'Ciudad ' || (o_custkey % 25) WHEN 1 THEN 'Barrio ' || (o_custkey % 9) ELSE 'Desconocida' END
    AS ubicacion,
  CASE o_orderkey % 4 WHEN 0 THEN 'Reputación ' || o_orderstatus WHEN 1 THEN 'Verde ' || o_orderpriority ELSE 'Desconocida' END
    AS reputacion,
  CASE o_orderkey % 4 WHEN 0 THEN 'Nuevo' ELSE 'No disponible' END AS condicion
FROM orders"""
ORACLE["posting_date_pick"] = f"""
WITH {RAW_P} SELECT pos, coalesce(CASE pos % 3 WHEN 0 THEN nullif(fecha_publicacion, '')
  WHEN 1 THEN {_strip("fecha_publicacion")} END, 'No encontrado') AS fecha FROM rawp"""


def _status(expr: str) -> str:
    return f"""CASE WHEN {_has(f"lower({expr})", "robot", "captcha", "blocked", "demasiadas solicitudes")} THEN 'blocked'
      WHEN length({_strip(expr)}) < 200 THEN 'thin' ELSE 'ok' END AS status"""


ORACLE["page_status"] = f"SELECT doc_id, {_status('text')} FROM documents"
ORACLE["page_status_html"] = f"""
WITH bodies AS (SELECT page_id, {_untag("regexp_extract(html, '<body>(.*)', 1, 's')")} AS body FROM pages)
SELECT page_id, {_status("body")} FROM bodies"""

ORACLE["run_listing_session_counts"] = _session_counts(
    "listings", ALL_CARDS, "part", "categoria", st.LISTING_TERMS,
    "CASE WHEN url_producto <> 'N/A' THEN url_producto ELSE producto || '_' || precio || '_' || vendedor END",
    "(SELECT count(*) FROM part WHERE p_partkey NOT IN (SELECT p_partkey FROM cards WHERE k NOT IN (4, 5)))",  # no usable block
)
ORACLE["run_posting_session_counts"] = _session_counts("postings", POSTED_CARDS, "customer", "term", st.SEGMENTS, "url_empleo")
ORACLE["run_session_failed"] = f"""
WITH done AS ({_posting_session("true")})
SELECT kind, (SELECT count(*) FROM customer) AS pages, rows_extracted, rows_valid, true AS success, CAST(NULL AS BOOLEAN) AS exists_already FROM done
UNION ALL SELECT kind, (SELECT count(*) FROM customer), rows_extracted, NULL, false, true FROM done"""

# --- normalisers ---------------------------------------------------------------------------------------------------------

ORACLE["clean_text_listing"] = f"WITH {RAW_L}, {CLEAN_L} SELECT * EXCLUDE (precio) FROM cleanl"
ORACLE["clean_text_posting"] = f"WITH {RAW_P}, {CLEAN_P} SELECT * FROM cleanp"
ORACLE["clean_price_text"] = f"WITH {RAW_L} SELECT {LISTING_ORDER}, {PRICE_TEXT} AS precio FROM raw"
ORACLE["valid_listing"] = f"WITH {RAW_L}, {CLEAN_L} SELECT producto, precio FROM cleanl WHERE {VALID_L}"
ORACLE["valid_posting"] = f"WITH {RAW_P}, {CLEAN_P} SELECT titulo_puesto, empresa, url_empleo FROM cleanp WHERE {VALID_P}"
ORACLE["parse_valid_listing"] = f"""
WITH {RAW_L} SELECT producto, precio, {LISTING_ORDER} FROM raw
WHERE length({_strip("producto")}) >= 5 AND precio NOT IN ('', 'N/A')"""
ORACLE["parse_valid_posting"] = f"""
WITH {RAW_P} SELECT pos, titulo_puesto FROM rawp
WHERE titulo_puesto NOT IN ('', 'No encontrado') AND empresa NOT IN ('', 'No encontrado')"""
ORACLE["parse_price"] = f"""
WITH {LISTINGS} SELECT r.orden_1, r.orden_2, r.orden_3, r.orden_4, r.orden_5, r.precio, l.precio_numerico
FROM raw r JOIN listings l USING ({LISTING_ORDER})"""
for _name, _source, _target in (
    ("clean_vendor", "vendedor", "vendedor_limpio"),
    ("classify_reputation", "reputacion_vendedor", "reputacion_limpia"),
    ("flag_available", "disponible", "disponible_bool"),
    ("flag_free_shipping", "envio_gratis", "envio_gratis_bool"),
):
    ORACLE[_name] = f"WITH {LISTINGS} SELECT {_source}, {_target}, count(*) AS n FROM listings GROUP BY ALL"
for _name, _source, _target in (
    ("classify_experience", "nivel_experiencia", "nivel_experiencia_limpio"),
    ("classify_modality", "modalidad", "modalidad_limpia"),
):
    ORACLE[_name] = f"WITH {POSTINGS} SELECT {_source}, {_target}, count(*) AS n FROM postings GROUP BY ALL"
ORACLE["parse_posted_at"] = f"WITH {POSTINGS} SELECT pos, fecha_publicacion, fecha_publicacion_dt FROM postings"
ORACLE["parse_posted_at_strict"] = f"""
WITH {_postings(STRICT)} SELECT pos, fecha_publicacion, fecha_publicacion_dt FROM postings"""
ORACLE["parse_posted_at_documents"] = f"SELECT doc_id, {_posted('text', 'lower(text)', UNITS)} AS posted_at FROM documents"
ORACLE["title_case_documents"] = f"SELECT doc_id, {_title('lower(text)')} AS titled FROM documents"
ORACLE["price_band"] = f"WITH {LISTINGS} SELECT {LISTING_ORDER}, rango_precio FROM listings"
ORACLE["price_band_six"] = f"""
WITH {LISTINGS} SELECT {LISTING_ORDER}, CASE WHEN precio_numerico < 50000 THEN 'Muy Bajo' WHEN precio_numerico < 100000 THEN 'Bajo'
  WHEN precio_numerico <= 300000 THEN 'Medio-Bajo' WHEN precio_numerico <= 500000 THEN 'Medio'
  WHEN precio_numerico <= 1000000 THEN 'Alto' ELSE 'Premium' END AS rango_precio FROM listings"""
ORACLE["age_band"] = f"SELECT event_id, {_age('(ts + INTERVAL 4 DAY)')} AS categoria_fecha FROM events"
ORACLE["value_score"] = f"WITH {LISTINGS} SELECT {LISTING_ORDER}, puntaje_valor FROM listings"

# --- joins ---------------------------------------------------------------------------------------------------------------


def _enriched_listings(condition: str) -> str:
    columns = [n for n in fv.LISTING_COLUMNS if n not in ("ubicacion", "reputacion_vendedor")]
    return f"""
WITH {RAW_L}, fetched AS ({st.LISTING_DETAILS.format(**_TABLES)}),
details AS (SELECT * FROM fetched
  QUALIFY row_number() OVER (PARTITION BY url ORDER BY fetched_at DESC, ubicacion, reputacion_vendedor) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY categoria ORDER BY {LISTING_ORDER}) AS rn FROM raw)
SELECT {", ".join("r." + n for n in columns)}, {", ".join("r." + n for n in st.LISTING_ORDER)},
  coalesce(nullif(d.ubicacion, 'Desconocida'), r.ubicacion) AS ubicacion,
  coalesce(nullif(d.reputacion_vendedor, 'Desconocida'), r.reputacion_vendedor) AS reputacion_vendedor
FROM ranked r LEFT JOIN details d ON {condition} starts_with(r.url_producto, 'http') AND d.url = r.url_producto"""


ORACLE["enrich_listings"] = _enriched_listings("r.rn <= 8 AND")
ORACLE["enrich_listings_all"] = _enriched_listings("")
ORACLE["enrich_listings_recrawled"] = f"SELECT a.* FROM ({_enriched_listings('')}) a, range(2)"
DEDUP_P = f"""{RAW_P}, {_number_terms()},
uniquep AS (SELECT * FROM numbered QUALIFY row_number() OVER (PARTITION BY
  CASE WHEN url_empleo <> 'No encontrado' THEN url_empleo ELSE titulo_puesto || '_' || empresa END ORDER BY term_no, pos) = 1)"""


def _enriched_postings(condition: str) -> str:
    return f"""
WITH {DEDUP_P}, fetched AS ({st.POSTING_DETAILS.format(**_TABLES)}),
details AS (SELECT * FROM fetched QUALIFY row_number() OVER (PARTITION BY url ORDER BY fetched_at DESC, descripcion_completa,
  nivel_experiencia, beneficios_ofrecidos) = 1),
ranked AS (SELECT *, row_number() OVER (ORDER BY term_no, pos) AS rn FROM uniquep)
SELECT r.* EXCLUDE (rn) REPLACE (
  coalesce(substring({_strip("nullif(d.descripcion_completa, 'No disponible')")}, 1, 200) || '...', r.descripcion_breve)
    AS descripcion_breve,
  coalesce(nullif(d.nivel_experiencia, 'No disponible'), r.nivel_experiencia) AS nivel_experiencia,
  coalesce(nullif(d.beneficios_ofrecidos, 'No disponible'), r.beneficios_ofrecidos) AS beneficios_ofrecidos)
FROM ranked r LEFT JOIN details d ON {condition} starts_with(r.url_empleo, 'http') AND d.url = r.url_empleo"""


ORACLE["enrich_postings"] = _enriched_postings("")
ORACLE["enrich_postings_capped"] = _enriched_postings("r.rn <= 20 AND")

# --- reports -------------------------------------------------------------------------------------------------------------

ORACLE["report_price_band"] = f"""
WITH {LISTINGS} SELECT rango_precio, count(producto) AS cantidad_productos, {_cents("avg(precio_numerico)")} AS precio_promedio,
  {_cents("min(precio_numerico)")} AS precio_minimo, {_cents("max(precio_numerico)")} AS precio_maximo
FROM listings GROUP BY rango_precio"""
VENDORS = f"""
WITH {LISTINGS}, vendors AS (
  SELECT vendedor_limpio, reputacion_limpia, count(producto) AS cantidad_productos,
    {_cents("avg(precio_numerico)")} AS precio_promedio,
    count(*) FILTER (disponible_bool) AS productos_disponibles,
    count(*) FILTER (envio_gratis_bool) AS productos_envio_gratis
  FROM listings GROUP BY vendedor_limpio, reputacion_limpia)"""
ORACLE["report_vendor"] = f"{VENDORS} SELECT * FROM vendors ORDER BY cantidad_productos DESC, vendedor_limpio, reputacion_limpia"
ORACLE["rank_sort"] = f"""{VENDORS} SELECT CAST(row_number() OVER (ORDER BY cantidad_productos DESC, vendedor_limpio, reputacion_limpia) - 1
  AS BIGINT) AS place, vendedor_limpio, reputacion_limpia, cantidad_productos FROM vendors"""
RANKING = f"""
WITH {LISTINGS} SELECT producto, precio_numerico, reputacion_limpia, disponible_bool, envio_gratis_bool, puntaje_valor, categoria,
  vendedor_limpio FROM listings"""
ORACLE["report_value_ranking"] = RANKING
RANKING_ORDER = """puntaje_valor DESC, producto NULLS FIRST, precio_numerico,
  reputacion_limpia, disponible_bool, envio_gratis_bool, categoria NULLS FIRST, vendedor_limpio"""
ORACLE["report_value_ranking_top"] = f"{RANKING} ORDER BY {RANKING_ORDER} LIMIT 100"
ORACLE["report_value_ranking_placed"] = f"SELECT *, row_number() OVER (ORDER BY {RANKING_ORDER}) - 1 AS place FROM ({RANKING})"


def _posting_report(*keys: str) -> str:
    names = ", ".join(keys)
    return f"""
WITH {POSTINGS} SELECT {names}, count(titulo_puesto) AS cantidad_empleos, count(DISTINCT empresa) AS empresas_unicas
FROM postings WHERE {keys[-1]} IS NOT NULL GROUP BY {names}"""


ORACLE["report_posting_age"] = _posting_report("categoria_fecha")
ORACLE["report_experience"] = _posting_report("nivel_experiencia_limpio")
ORACLE["report_modality_location"] = _posting_report("modalidad_limpia", "ubicacion")
for _name in ("report_posting_age", "report_experience", "report_modality_location"):
    ORACLE[f"{_name}_merged"] = ORACLE[_name]
ORACLE["summary"] = f"""
WITH {LISTINGS}, {POSTINGS},
l AS (SELECT count(*) AS total_productos_ml, {_cents("avg(precio_numerico)")} AS precio_promedio_ml,
  {_cents("median(precio_numerico)")} AS precio_mediano_ml, count(*) FILTER (disponible_bool) AS productos_disponibles,
  count(*) FILTER (envio_gratis_bool) AS productos_envio_gratis FROM listings),
p AS (SELECT count(*) AS total_empleos_linkedin, count(*) FILTER (modalidad_limpia = 'Remoto') AS empleos_remotos,
  count(*) FILTER (modalidad_limpia = 'Presencial') AS empleos_presenciales,
  count(*) FILTER (modalidad_limpia = 'Híbrido') AS empleos_hibridos FROM postings)
SELECT '{st.AS_OF}' AS fecha_analisis, * FROM l, p"""
ORACLE["exact_median"] = "SELECT median(l_extendedprice) AS median FROM lineitem"
ORACLE["category_counts"] = f"""
WITH {RAW_L}, counts AS (SELECT coalesce(nullif(categoria, ''), 'sin_categoria') AS categoria, count(*) AS cantidad_productos
  FROM raw GROUP BY 1) SELECT *, count(*) OVER () AS categorias FROM counts"""
ORACLE["category_price_stats"] = f"""
WITH {LISTINGS} SELECT categoria, round(avg(precio_numerico), 3) AS mean, count(precio_numerico) AS count,
  round(stddev_samp(precio_numerico), 3) AS std FROM listings WHERE categoria IS NOT NULL GROUP BY categoria"""
ORACLE["modality_distribution"] = f"WITH {RAW_P} SELECT modalidad, count(*) AS cantidad FROM rawp GROUP BY modalidad"
ORACLE["average_price_simple"] = f"""
WITH {RAW_L}, whole AS (SELECT replace(replace(precio, '$', ''), '.', '') AS digits FROM raw WHERE precio <> 'N/A')
SELECT round(avg(CASE WHEN regexp_full_match(trim(digits), '[+-]?[0-9]+') THEN CAST(trim(digits) AS BIGINT) END), 4)
  AS precio_promedio FROM whole"""


def _dedup_listings(key: str) -> str:
    return f"""
WITH {RAW_L} SELECT * FROM raw QUALIFY row_number() OVER (PARTITION BY
  CASE WHEN url_producto <> 'N/A' THEN {key} ELSE producto || '_' || precio || '_' || vendedor END ORDER BY {LISTING_ORDER}) = 1"""


ORACLE["dedup_listings_incremental"] = _dedup_listings("url_producto").replace("ORDER BY ", f"ORDER BY {st.LISTING_ORDER[1]} % 3, ")
ORACLE["dedup_listings"] = _dedup_listings("url_producto")
ORACLE["dedup_listings_canonical"] = _dedup_listings("regexp_extract(url_producto, '^[^?#]*')")
ORACLE["run_metrics"] = f"""
WITH {RAW_L}, unique_rows AS ({_dedup_listings("url_producto").replace(f"WITH {RAW_L} ", "")}),
cleaned AS ({CLEAN_L.replace("cleanl AS (", "").replace(" FROM raw)", " FROM unique_rows")}),
counts AS (SELECT (SELECT count(*) FROM raw) AS rows_in, count(*) AS rows_unique, count(*) FILTER ({VALID_L}) AS rows_valid FROM cleaned)
SELECT *, rows_in - rows_unique AS duplicates_dropped FROM counts"""
ORACLE["dedup_postings"] = f"WITH {DEDUP_P} SELECT * FROM uniquep"
ORACLE["dedup_postings_incremental"] = f"WITH {DEDUP_P} SELECT * FROM uniquep".replace("END ORDER BY term_no", "END ORDER BY pos % 3, term_no")
for _name, _n in (("cap_per_term", 50), ("cap_per_term_large", 5000)):
    ORACLE[_name] = f"""
WITH {RAW_L} SELECT * FROM raw QUALIFY row_number() OVER (PARTITION BY categoria ORDER BY {LISTING_ORDER}) <= {_n}"""
ORACLE["union_terms"] = f"WITH {RAW_P} " + " UNION ALL ".join(
    f"SELECT *, {no} AS term_no FROM rawp WHERE term = '{term}'" for no, term in enumerate(st.POSTING_TERMS)
)
ORACLE["number_terms"] = f"WITH {RAW_P}, {_number_terms()} SELECT * FROM numbered WHERE term_no IS NOT NULL"


# Texts (and flags), then numbers, of every report.
REPORTS = {
    "productos_por_rango_precio": ("report_price_band", "rango_precio", "cantidad_productos precio_promedio precio_minimo precio_maximo"),
    "productos_por_vendedor": (
        "report_vendor", "vendedor_limpio reputacion_limpia",
        "cantidad_productos precio_promedio productos_disponibles productos_envio_gratis",
    ),
    "productos_por_factor_personalizado": (
        "report_value_ranking", "producto reputacion_limpia disponible_bool envio_gratis_bool categoria vendedor_limpio",
        "precio_numerico puntaje_valor",
    ),
    "empleos_por_fecha_publicacion": ("report_posting_age", "categoria_fecha", "cantidad_empleos empresas_unicas"),
    "empleos_por_nivel_experiencia": ("report_experience", "nivel_experiencia_limpio", "cantidad_empleos empresas_unicas"),
    "empleo_por_factor_personalizado_modalidad_ubicacion": (
        "report_modality_location", "modalidad_limpia ubicacion", "cantidad_empleos empresas_unicas"
    ),
    "reporte_resumen": (
        "summary", "fecha_analisis",
        "total_productos_ml total_empleos_linkedin precio_promedio_ml precio_mediano_ml productos_disponibles "
        "productos_envio_gratis empleos_remotos empleos_presenciales empleos_hibridos",
    ),
}


def _report_values(report: str) -> str:
    source, texts, numbers = REPORTS[report]
    key = ", ".join(f"coalesce(nullif(CAST({name} AS VARCHAR), ''), '-')" for name in texts.split())
    values = ", ".join(f"CAST({name} AS DOUBLE)" for name in numbers.split())
    return f"""SELECT '{report}' AS report, concat_ws('|', {key}) AS row_key, unnest({numbers.split()}) AS name,
  unnest([{values}]) AS value FROM ({ORACLE[source]})"""


ORACLE["write_reports"] = ORACLE["run_all"] = " UNION ALL ".join(map(_report_values, REPORTS))
