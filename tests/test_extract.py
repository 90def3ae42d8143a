"""Extraction from a hand-written set of pages, the selector matcher, and whole sessions over these pages."""

import pytest
from pyspark.sql import functions as F

from vitrina import fixed_values as fv
from vitrina.operators import extract
from vitrina.operators.html import Document, parse_selector
from vitrina.plans import run
from vitrina.sources import staging

AS_OF = "2024-02-01 12:00:00"
HOST = "https://tienda.example.com"
FILL = "Descripción larga para que el bloque tenga más de cincuenta caracteres."

LISTING_PAGE = f"""<html><body><ul>
<li class="ui-search-layout__item"><a class="poly-component__title" href="/mesa-1">  Mesa de
  roble &amp; pino </a><span class="andes-money-amount__fraction">1.250</span><span class="poly-component__seller">Por ACME</span>
  <div class="poly-component__shipping"></div>$<img src="https://img/1.png"><p>{FILL}
<li class="ui-search-layout__item"><a class="poly-component__title" href="/mesa-1">Mesa repetida</a><span
  class="andes-money-amount__fraction">7</span>Envío {FILL}</li>
<li class="ui-search-layout__item"><h2><a href="http://otra/3">Silla</a></h2> $ {FILL}</li>
<li class="ui-search-layout__item">Publicidad {FILL}</li>
<li class="ui-search-layout__item"><span class="ui-search-item__title"><a href="http://otra/4">Estante</a></span>
  <b class="price-tag-fraction">99</b><i>PRECIO</i>{FILL}</li></ul></body></html>"""
OTHER_LAYOUT = "<body>" + "".join(
    f"""<div data-testid="search-result-{i}"><h2><a href="#{i}">Lámpara {i}</a></h2><span class="price-tag-fraction">{i}</span> $ {FILL}</div>"""
    for i in range(1, 31)) + "</body>"
POSTING_PAGE = """<ul>
<li><div><a href="/jobs/view/1?x=1"><span><strong>Analista</strong></span></a></div><div><span dir="ltr"><strong>no</strong></span>
 <span dir="ltr">Banco Uno</span></div><span dir="ltr">Comuna 4,
   Ciudad (Presencial)</span><time datetime="2024-01-30">hace 2 días</time></li>
<li><a href="https://e/jobs/view/2">Dev Python</a><span dir="ltr">Argentina</span><span dir="ltr">Beta</span><span>Hace 3 horas</span>
 <div class="job-card-container__snippet">""" + "palabra " * 60 + """</div></li>
<li><a href="/jobs/view/3">Sin empresa</a></li></ul>"""
DETAIL_PAGE = """<h1 class="ui-pdp-title">Mesa</h1><div><div class="ui-seller-info__header__title">Vendedor</div><div><p><span>Verde oscuro</span></p></div></div>
<div class="ui-seller-location"> Rosario </div>"""
PAGES = [
    (1, "http://l/1", LISTING_PAGE, "mesa"),
    (2, "http://l/2", OTHER_LAYOUT, "luz"),
    (3, "http://p/3", POSTING_PAGE, "dev"),
    (4, f"{HOST}/mesa-1", DETAIL_PAGE, "detalle"),
    (5, "http://t/5", "<body>poco texto</body>", "nada"),
    (6, "http://b/6", "<body>Verifique que no es un ROBOT " + FILL * 10 + "</body>", "nada"),
    (7, "http://v/7", None, "nada"),
]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame(PAGES, "page_id bigint, url string, html string, term string")


def texts(html, selector, scope=0):
    page = Document(html)
    return [page.inner_text(i) for i in page.select(scope, selector)]


def test_tree_of_untidy_pages():
    assert texts("<p>a<b>b<p>c</p>d<p>e", "p") == ["ab", "c", "e"]
    assert texts("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>", "li") == ["a", "b\nc", "c", "d"]
    assert texts("<table><tr><td>1<td>2<tr><td>3</table>", "tr") == ["1\n2", "3"]
    assert texts("<div>a</span></div></div><i>b</i>", "i") == ["b"]
    assert texts("<a title=\"x>y\">t</a><!-- <a>no</a> --><a b=c d>u</a>", "a") == ["t", "u"]
    assert texts("<script>if (a<b) '</p>'</script><style>p{}</style>x<p>y &lt;&amp;&#241;", "p") == ["y <&ñ"]
    assert texts("<div>uno<br>dos  \n tres<script>no</script><div>cuatro</div></div>", "div")[0] == "uno\ndos tres\ncuatro"
    assert texts("a < b > c <p class=>z", "p") == ["z"]
    assert Document("<div>x<script>y</script></div>").text_content(1) == "xy"
    deep = "<div>" * 5000 + "x"
    assert texts(deep, "div div")[-1] == "x"
    assert Document('<a "unclosed href="q>t').tag == ["#root", "a"]


def test_selectors():
    html = """<div id=r><div class="a b" k="one two"><span>1</span></div><div><span dir="ltr">Hola Mundo</span><em><strong>s</strong></em></div>
    <p>x</p><span>2</span></div>"""
    assert texts(html, ".a.b span") == ["1"]
    assert texts(html, "div.a, p") == ["1", "x"]
    assert texts(html, '[k="one two"]') == ["1"] and texts(html, "[k=one]") == [] and texts(html, '[k*="e t"]') == ["1"]
    assert texts(html, "div + div span") == ["Hola Mundo"]
    assert texts(html, "div:nth-child(2) span") == ["Hola Mundo"]
    assert texts(html, "div > span") == ["1", "Hola Mundo", "2"]
    assert texts(html, "div:has(strong) em") == ["s"]
    assert texts(html, "span:not([dir])") == ["1", "2"] and texts(html, "div:not(:has(strong)):has(span)") == ["1"]
    assert texts(html, 'span:has-text("hola  MUNDO")') == ["Hola Mundo"]
    page = Document("<ul><li><b><span>1</span></b></li></ul>")
    assert list(page.select(page.first(0, "li"), "ul span")) == []  # nothing outside the block counts
    with pytest.raises(ValueError):
        parse_selector("a:hover(x)")
    with pytest.raises(ValueError):
        parse_selector("a | b")


def test_all_fixed_selectors_are_understood():
    for name in dir(fv):
        if name.startswith(("LISTING_", "POSTING_")) and isinstance(getattr(fv, name), tuple) and any(
            "." in s or "[" in s for s in getattr(fv, name)
        ):
            for selector in getattr(fv, name):
                assert parse_selector(selector)


def test_listings(pages):
    rows = extract.extract_listings(pages, HOST, AS_OF, 50, blocks_per_page=20).orderBy("page_id", "pos").collect()
    first = [r for r in rows if r.page_id == 1]
    assert [(r.pos, r.producto, r.precio, r.vendedor, r.url_producto, r.envio_gratis, r.imagen_url) for r in first] == [
        (1, "Mesa de roble & pino", "$1.250", "Por ACME", f"{HOST}/mesa-1", "Sí", "https://img/1.png"),
        (2, "Mesa repetida", "$7", "N/A", f"{HOST}/mesa-1", "No", "N/A"),
        (5, "Estante", "$99", "N/A", "http://otra/4", "No", "N/A"),
    ]
    assert {(r.categoria, r.disponible, r.fecha_extraccion, r.ubicacion) for r in first} == {("mesa", "Sí", "2024-02-01", "")}
    assert [(r.pos, r.producto) for r in rows if r.page_id == 2] == [(i, f"Lámpara {i}") for i in range(1, 21)]
    assert {r.page_id for r in rows} == {1, 2}
    # The cap counts usable blocks, before cards without price are dropped.
    capped = extract.extract_listings(pages, HOST, AS_OF, max_cards=3, blocks_per_page=20).where("page_id = 1").collect()
    assert sorted(r.pos for r in capped) == [1, 2]


def test_postings(pages):
    rows = extract.extract_postings(pages, HOST, AS_OF).where("page_id = 3").orderBy("pos").collect()
    assert [(r.indice, r.titulo_puesto, r.empresa, r.ubicacion, r.url_empleo, r.modalidad, r.fecha_publicacion) for r in rows] == [
        (1, "Analista", "Banco Uno", "Comuna 4, Ciudad (Presencial)", f"{HOST}/jobs/view/1?x=1", "Presencial", "2024-01-30"),
        (2, "Dev Python", "Beta", "Argentina", "https://e/jobs/view/2", fv.NOT_FOUND, "Hace 3 horas"),
    ]
    assert [r.descripcion_breve for r in rows] == [fv.NOT_AVAILABLE, ("palabra " * 60)[:200] + "..."]
    assert {(r.nivel_experiencia, r.beneficios_ofrecidos) for r in rows} == {(fv.NOT_AVAILABLE, fv.NOT_AVAILABLE)}


def test_posting_containers(spark):
    card = '<a href="/jobs/view/{0}">Rol {0}</a><span dir="ltr">E{0}</span>'
    layouts = [
        "<ol>" + "".join(f"<li data-occludable-job-id={i}>" + card.format(i) for i in range(3)),
        "<ol>" + "".join("<li>" + "<div>" * 6 + card.format(i) + "</div>" * 6 for i in range(3)),
        "<ol>" + "".join("<li>" + card.format(i) for i in range(3)),
        "<div>" + card.format(0) + "</div>",
    ]
    frame = spark.createDataFrame(list(enumerate(layouts)), "page_id int, html string").withColumns({"url": F.lit(""), "term": F.lit("t")})
    counts = {r.page_id: r["count"] for r in extract.extract_postings(frame, HOST, AS_OF, 2).groupBy("page_id").count().collect()}
    assert counts == {0: 2, 1: 2, 2: 2}


def test_details(spark, pages):
    row = extract.listing_detail(pages.where("page_id = 4")).first()
    assert tuple(row) == (f"{HOST}/mesa-1", "Mesa", fv.NOT_AVAILABLE, fv.NOT_AVAILABLE, "Rosario", "Verde oscuro", fv.NOT_AVAILABLE)
    assert extract.listing_detail(pages).count() == 6  # the page without content is dropped
    html = ("<p class='job-details-jobs-unified-top-card__job-insight'>Jornada</p><p class='job-details-jobs-unified-top-card__job-insight'>"
            "\"Sin   experiencia\"</p><div class='jobs-unified-top-card__job-insight'>Otros Beneficios: auto</div><div class='description__text'>  Hola </div>")
    frame = spark.createDataFrame([(1, "u", html)], "page_id int, url string, html string")
    assert tuple(extract.posting_detail(frame).first()) == ("u", "Hola", "Sin experiencia", "Otros Beneficios: auto")


def test_page_status(pages):
    got = {r.page_id: r.status for r in extract.page_statuses(pages).collect()}
    assert (got[1], got[5], got[6], got[7]) == ("ok", "thin", "blocked", "thin")


def test_generic_operators(pages):
    assert extract.first_match_text(pages, ("h3", "h1", "h2")).where("page_id IN (1, 4, 5)").orderBy("page_id").collect() == [
        (1, "Silla"), (4, "Mesa"), (5, "N/A")]
    assert extract.attribute_extract(pages, "img", "src").where("value <> 'N/A'").collect() == [(1, "https://img/1.png")]
    assert extract.presence_flag(pages, ("time", "nav")).where("flag = 'Sí'").collect() == [(3, "Sí")]
    blocks = extract.extract_containers(pages, ("nav", "ul li"), 2).where("page_id = 1").select("pos").collect()
    assert [r.pos for r in blocks] == [1, 2]


def test_sessions(spark, pages, tmp_path):
    details = pages.where("page_id = 4").select("page_id", "url", "html", F.lit(1).alias("fetched_at"))
    result = run.run_listing_session(pages, details, ["luz", "mesa"], HOST, str(tmp_path), AS_OF, stamp="1", blocks_per_page=20, per_term=8).first()
    assert (result.rows_extracted, result.rows_unique, result.duplicates_dropped, result.rows_valid, result.success) == (23, 22, 1, 22, True)
    rows = {r.producto: r for r in spark.read.csv(result.path, header=True).collect()}
    assert (rows["Mesa de roble & pino"].ubicacion, rows["Mesa de roble & pino"].reputacion_vendedor) == ("Rosario", "Verde oscuro")
    assert rows["Estante"].ubicacion == "No disponible" and "Mesa repetida" not in rows
    trial = run.run_listing_session(pages, None, ["luz"], HOST, str(tmp_path), AS_OF, fv.ROWS_PER_TERM_TRIAL, stamp="2", blocks_per_page=20).first()
    assert trial.rows_valid == 10
    empty = run.run_listing_session(pages, None, ["nada"], HOST, str(tmp_path), AS_OF, stamp="3").first()
    assert (empty.success, empty.path, empty.rows_extracted) == (False, None, 0) and not (tmp_path / "listings_3.csv").exists()
    jobs = run.run_posting_session(pages, None, ["dev"], HOST, str(tmp_path), AS_OF, stamp="1").first()
    assert (jobs.rows_extracted, jobs.rows_valid) == (2, 2)


def test_sessions_leave_only_their_snapshot(spark, pages, tmp_path, monkeypatch):
    shared = tmp_path / "shared"
    shared.mkdir()
    monkeypatch.setattr(staging, "shared_root", lambda spark: str(shared))
    details = pages.where("page_id = 4").select("page_id", "url", "html", F.lit(1).alias("fetched_at"))
    for number, per_term in enumerate((8, None)):
        done = run.run_listing_session(pages, details, ["luz", "mesa"], HOST, str(tmp_path / "out"), AS_OF, stamp=str(number), per_term=per_term).first()
        assert done.success and list(shared.iterdir()) == []
        rows = {r.producto: r for r in spark.read.csv(done.path, header=True).collect()}
        assert (rows["Mesa de roble & pino"].ubicacion, rows["Mesa de roble & pino"].reputacion_vendedor) == ("Rosario", "Verde oscuro")


def test_session_counts_and_failures(spark, pages, tmp_path):
    odd = spark.createDataFrame([
        (90, "u", "<body>Are you a robot? Solve the captcha.</body>", "luz"), (91, "u", "<body>short</body>", "luz"), (92, "u", None, "luz"),
    ], "page_id long, url string, html string, term string")
    both = pages.select("page_id", "url", "html", "term").unionByName(odd.select(*[F.col(n).cast(pages.schema[n].dataType) for n in odd.columns]))
    alone = run.run_listing_session(pages, None, ["luz", "mesa"], HOST, str(tmp_path), AS_OF, stamp="a").first()
    result = run.run_listing_session(both, None, ["luz", "mesa"], HOST, str(tmp_path), AS_OF, stamp="b", fmt="parquet").first()
    assert (result.pages - alone.pages, result.pages_blocked - alone.pages_blocked, result.pages_thin - alone.pages_thin) == (3, 1, 2)
    assert result.path.endswith("listings_b.parquet") and spark.read.parquet(result.path).count() == result.rows_valid == alone.rows_valid
    assert sum(result.category_counts.values()) == result.rows_unique and set(result.category_counts) <= {"luz", "mesa"}
    other = run.run_listing_session(pages, None, ["luz"], HOST, str(tmp_path), AS_OF, stamp="c").first()
    assert other.rows_other_terms + other.rows_extracted == alone.rows_other_terms + alone.rows_extracted
    again = run.run_listing_session(pages, None, ["luz"], HOST, str(tmp_path), AS_OF, stamp="c").first()
    assert (again.success, again.path) == (False, None) and "exists" in again.error and again.rows_extracted == other.rows_extracted
    none = run.run_listing_session(pages, None, ["nada"], HOST, str(tmp_path), AS_OF, stamp="d").first()
    assert none.error == run.NO_ROWS and none.category_counts == {}


def test_stray_end_tags_take_linear_time():
    import time

    def seconds(n):
        started = time.perf_counter()
        page = "<div>" * 300 + "<b>" * 300 + "</section></i></em>" * n
        Document(page)
        return time.perf_counter() - started

    seconds(2000)
    assert seconds(40_000) < 60 * max(seconds(4_000), 0.005)


def test_no_cap_is_the_default(spark):
    from vitrina.operators import ingest

    many = "".join(f'<li class="ui-search-layout__item"><h2>Mesa {k} roble</h2></li>' for k in range(70))
    frame = spark.createDataFrame([(1, "u", many, "mesa")], "page_id long, url string, html string, term string")
    capped = run.listing_cards(frame, ["mesa"], HOST, AS_OF, 50, 20).count()
    everything = run.listing_cards(frame, ["mesa"], HOST, AS_OF, None).count()
    assert everything >= capped and run.listing_cards(frame, ["mesa"], HOST, AS_OF).count() == everything
    assert ingest.cap_per_term(spark.range(99).selectExpr("id AS pos", "'a' AS categoria")).count() == 99
