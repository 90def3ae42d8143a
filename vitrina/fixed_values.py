"""Texts, keyword lists, edges and selectors that decide results.

They are the data contract, so they are written out plainly and in their natural order. Everything here is the default of a
parameter somewhere; no logic lives in this file.
"""

# --- Fixed values: snapshot columns -----------------------------------------------------------------------------------
LISTING_COLUMNS = (
    "producto", "precio", "vendedor", "ubicacion", "reputacion_vendedor",
    "fecha_extraccion", "url_producto", "disponible", "envio_gratis", "categoria",
)
POSTING_COLUMNS = (
    "indice", "fecha_extraccion", "titulo_puesto", "empresa", "ubicacion", "url_empleo",
    "modalidad", "fecha_publicacion", "descripcion_breve", "nivel_experiencia", "beneficios_ofrecidos",
)

# --- Fixed values: texts a CSV reader of the pandas family treats as missing ---------------------------------------------
NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

# --- Fixed values: characters removed by a Unicode-aware strip -----------------------------------------------------------
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# --- Fixed values: sentinel texts per stage ------------------------------------------------------------------------------
MISSING = "N/A"
NOT_FOUND = "No encontrado"
NOT_AVAILABLE = "No disponible"
UNKNOWN_PLACE = "Desconocida"
NO_PRICE = "Precio no disponible"
NO_VENDOR = "Vendedor no especificado"
NOT_SPECIFIED = "No especificado"
NO_CATEGORY = "sin_categoria"
LISTING_SENTINELS = ("N/A", "Desconocido")
POSTING_SENTINELS = ("N/A", "Desconocido", "Sin información")
YES, NO = "Sí", "No"

# --- Fixed values: flags -------------------------------------------------------------------------------------------------
AVAILABLE_WORDS = ("sí", "si", "true", "1", "disponible")
FREE_SHIPPING_WORDS = ("sí", "si", "true", "1", "gratis")

# --- Fixed values: reputation --------------------------------------------------------------------------------------------
REPUTATION_GOOD = "Buena reputación"
REPUTATION_REGULAR = "Reputación regular"
REPUTATION_BAD = "Mala reputación"
REPUTATION_NEW = "Vendedor nuevo"
REPUTATION_NONE = "Sin información de reputación"
REPUTATION_RULES = (
    (("verde", "buena", "excelente"), REPUTATION_GOOD),
    (("amarilla", "regular"), REPUTATION_REGULAR),
    (("roja", "mala"), REPUTATION_BAD),
    (("nuevo", "sin reputación"), REPUTATION_NEW),
)

# --- Fixed values: seniority ---------------------------------------------------------------------------------------------
LEVEL_ENTRY, LEVEL_MID, LEVEL_SENIOR = "Entry level", "Mid level", "Senior level"
DEVELOPER_WORDS = ("desenvolvedor", "developer")
DEVELOPER_LEVEL_RULES = ((("senior", "sr"), LEVEL_SENIOR), (("junior", "jr"), LEVEL_ENTRY))
LEVEL_RULES = (
    (("entry", "junior", "trainee"), LEVEL_ENTRY),
    (("senior", "sr"), LEVEL_SENIOR),
    (("mid", "semi", "pleno"), LEVEL_MID),
)

# --- Fixed values: work mode ---------------------------------------------------------------------------------------------
MODE_REMOTE, MODE_ONSITE, MODE_HYBRID = "Remoto", "Presencial", "Híbrido"
MODE_RULES = (
    (("remoto", "remote"), MODE_REMOTE),
    (("presencial", "on-site", "oficina"), MODE_ONSITE),
    (("híbrido", "hybrid"), MODE_HYBRID),
)
CARD_MODE_RULES = ((("híbrido",), MODE_HYBRID), (("remoto",), MODE_REMOTE), (("presencial",), MODE_ONSITE))

# --- Fixed values: places ------------------------------------------------------------------------------------------------
LOCATION_WORDS = (
    "argentina", "buenos aires", "comuna", "remoto", "híbrido", "presencial", "provincia", "ciudad",
)

# --- Fixed values: relative dates (words of the unit, hours in one unit) -------------------------------------------------
DATE_UNITS = (
    (("hora", "hour"), 1),
    (("día", "day", "hace"), 24),
    (("semana", "week"), 168),
    (("mes", "month"), 720),
)
STRICT_DATE_UNITS = (
    (("hora", "hour"), 1),
    (("semana", "week"), 168),
    (("mes", "month"), 720),
    (("día", "day", "hace"), 24),
)
DATE_MISSING = ("no encontrado", "nan")
DATE_DEFAULT_HOURS = 12
AGE_FIRST, AGE_WEEK, AGE_OLDER = "Últimas 24 horas", "Última semana", "Más de una semana"

# --- Fixed values: page text that means no usable content ----------------------------------------------------------------
BLOCK_WORDS = ("robot", "captcha", "blocked", "demasiadas solicitudes")
THIN_PAGE_CHARS = 200

# --- Fixed values: listing card selectors --------------------------------------------------------------------------------
LISTING_CONTAINERS = (".ui-search-layout__item", ".ui-search-results__item", 'div[data-testid*="result"]')
LISTING_TITLES = (".poly-component__title", ".ui-search-item__title", "h2 a")
LISTING_PRICES = (".andes-money-amount__fraction", ".price-tag-fraction")
LISTING_LINKS = ("a.poly-component__title", ".ui-search-item__title a")
LISTING_SELLERS = (".poly-component__seller", ".ui-search-item__seller-info")
LISTING_SHIPPING = (".poly-component__shipping", ".ui-search-item__shipping")
LISTING_BLOCK_WORDS = ("$", "precio", "envío")
LISTING_BLOCK_CHARS = 50
LISTING_BLOCKS_PER_PAGE = 20

# --- Fixed values: listing detail selectors ------------------------------------------------------------------------------
LISTING_DETAIL_TITLES = (".ui-pdp-title", "h1.ui-pdp-title")
LISTING_DETAIL_PRICES = (".andes-money-amount__fraction",)
LISTING_DETAIL_SELLERS = (".ui-pdp-seller__header__title",)
LISTING_DETAIL_CONDITIONS = (".ui-pdp-subtitle",)
LISTING_DETAIL_PLACES = ("div.ui-seller-info__status-info__subtitle", ".ui-seller-location")
LISTING_DETAIL_REPUTATIONS = (
    "div.ui-seller-info__header__title + div span", ".ui-seller-info__status-info__title",
)

# --- Fixed values: posting card selectors --------------------------------------------------------------------------------
POSTING_LINK = 'a[href*="/jobs/view/"]'
POSTING_CONTAINERS = (
    'ul li:has(a[href*="/jobs/view/"])',
    "li[data-occludable-job-id]",
    'li:has(div div div div div div a[href*="/jobs/view/"])',
)
POSTING_TITLES = (
    'a[href*="/jobs/view/"] span strong',
    'a[href*="/jobs/view/"] strong',
    'div div div div div div a[href*="/jobs/view/"] span strong',
    'a[href*="/jobs/view/"]',
)
POSTING_COMPANIES = (
    'span[dir="ltr"]:not(:has(strong))', 'div:nth-child(2) span[dir="ltr"]', 'div + div span[dir="ltr"]',
)
POSTING_PLACES = (
    'span[dir="ltr"]:has-text("Argentina")',
    'span[dir="ltr"]:has-text("Buenos Aires")',
    'span[dir="ltr"]:has-text("Comuna")',
    'ul li span[dir="ltr"]',
)
POSTING_TIME_ATTR = ("time[datetime]",)
POSTING_TIME_TEXT = ("time", 'span:has-text("Hace")', 'span:has-text("días")')
POSTING_SNIPPETS = (
    ".job-search-card__snippet", ".job-card-container__snippet",
    'div:has-text("Descripción")', 'span:has-text("Descripción")',
)
SNIPPET_CHARS = 200

# --- Fixed values: posting detail selectors ------------------------------------------------------------------------------
POSTING_DETAIL_TEXTS = (".jobs-description-content__text", ".jobs-box__html-content", ".description__text")
POSTING_DETAIL_LEVELS = (
    'span[dir="ltr"].job-details-jobs-unified-top-card__job-insight-view-model-secondary',
    ".job-details-jobs-unified-top-card__job-insight-view-model-secondary",
    'span[dir="ltr"][class*="job-insight-view-model-secondary"]',
    'span[class*="job-details-jobs-unified-top-card__job-insight-view-model-secondary"]',
    ".job-details-jobs-unified-top-card__job-insight",
    ".jobs-unified-top-card__job-insight",
)
POSTING_DETAIL_BENEFITS = (
    '.jobs-unified-top-card__job-insight:has-text("beneficios")',
    '.job-details-jobs-unified-top-card__job-insight:has-text("beneficios")',
    ".jobs-benefits",
)
LEVEL_WORDS = (
    "prácticas", "sin experiencia", "algo de responsabilidad", "intermedio", "director", "ejecutivo",
    "entry", "senior", "mid", "junior", "level", "práctica", "entry level", "mid level", "senior level",
)

# --- Fixed values: caps --------------------------------------------------------------------------------------------------
ROWS_PER_TERM = 50
ROWS_PER_TERM_TRIAL = 10
ENRICHED_LISTINGS_PER_TERM = 8
ENRICHED_POSTINGS = 20
