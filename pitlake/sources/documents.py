"""Captured bodies to rows: JSON, HTML and delimited texts, each with an explicit schema.

A parser takes a frame with a body column and returns rows; bodies that do not parse are what malformed()
returns, never an empty success.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitlake.functions.scalars import clean_number, micros_of, period_end, period_start, publication_instant

MINUTE = 60_000


def malformed(bodies: DataFrame, schema: str) -> DataFrame:
    """Bodies that do not parse under the schema, for a quarantine table."""
    parsed = F.from_json("body", f"{schema[:-1]}, _bad string>" if schema.startswith("struct<") else schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    bad = F.col("__p").isNull() | (F.col("__p._bad").isNotNull() if schema.startswith("struct<") else F.lit(False))
    return bodies.withColumn("__p", parsed).where(bad).drop("__p")


def bars(pages: DataFrame, daily: bool = False) -> DataFrame:
    """Body {"bars": {symbol: [{t, o, h, l, c, v}]}} to bars: start and end in ms, available at the end (daily: two days later)."""
    row = F.from_json("body", "struct<bars:map<string,array<struct<t:string,o:double,h:double,l:double,c:double,v:double>>>>")
    flat = pages.select(row.alias("b")).select(F.explode("b.bars").alias("symbol", "rows")).select("symbol", F.inline("rows"))
    start = F.unix_millis(F.to_timestamp("t"))
    wide = 86_400_000 if daily else MINUTE
    return flat.select("symbol", start.alias("start"), (start + wide).alias("end"), (start + (2 * 86_400_000 if daily else MINUTE)).alias("available_at"), F.col("o").alias("open"), F.col("h").alias("high"), F.col("l").alias("low"), F.col("c").alias("close"), F.col("v").alias("volume"))


def assets(pages: DataFrame) -> DataFrame:
    """An array of assets to series metadata."""
    rows = F.from_json("body", "array<struct<id:string,symbol:string,name:string,exchange:string,status:string,`class`:string>>")
    return pages.select(F.inline(rows)).select("id", "symbol", "name", "exchange", (F.col("status") == "active").alias("active"))


_FACT = "struct<start:string,end:string,val:string,accn:string,form:string,filed:string>"


def company_facts(pages: DataFrame, cutoff: str | None = None) -> DataFrame:
    """facts[taxonomy][tag].units[unit][] to rows: start defaults to end (an instant), filings after the cutoff are
    left out, published at the end of the filing date in New York, revision numbered by (filed, source, amount) in the fact key."""
    body = F.from_json("body", f"struct<cik:string,facts:map<string,map<string,struct<units:map<string,array<{_FACT}>>>>>>")
    flat = (
        pages.select(body.alias("b")).select(F.col("b.cik").alias("entity"), F.explode("b.facts").alias("taxonomy", "tags"))
        .select("entity", "taxonomy", F.explode("tags").alias("tag", "t")).select("entity", "taxonomy", "tag", F.explode("t.units").alias("unit", "rows")).select("entity", "taxonomy", "tag", "unit", F.inline("rows"))
    )
    if cutoff is not None:
        flat = flat.where(F.col("filed") <= cutoff)
    key = ["entity", "taxonomy", "tag", "unit", "period_start", "period_end"]
    filed = F.col("filed").cast("date")
    rows = flat.select("entity", "taxonomy", "tag", "unit", F.coalesce("start", "end").cast("date").alias("period_start"), F.col("end").cast("date").alias("period_end"), F.when(F.col("start").isNull(), "instant").otherwise("duration").alias("period_kind"), micros_of(F.col("val")).alias("value_micros"), F.col("accn").alias("source_id"), filed.alias("filed"), publication_instant(filed, "America/New_York").alias("published"))
    return rows.withColumn("revision", F.row_number().over(Window.partitionBy(*key).orderBy("filed", "source_id", "value_micros")))


def same_day_conflicts(facts: DataFrame) -> DataFrame:
    """Fact keys with two amounts filed on one day; they must stop an import."""
    return facts.groupBy("entity", "taxonomy", "tag", "unit", "period_start", "period_end", "filed").agg(F.count_distinct("value_micros").alias("amounts")).where("amounts > 1")


def filing_index(pages: DataFrame) -> DataFrame:
    """Parallel arrays of an index to one row a filing, with the document's path; publication is acceptance, else the end of the filing date."""
    body = F.from_json("body", "struct<cik:string,filings:struct<recent:struct<accessionNumber:array<string>,primaryDocument:array<string>,filingDate:array<string>,acceptanceDateTime:array<string>>>>")
    r = "b.filings.recent."
    zipped = F.arrays_zip(*[F.col(r + c).alias(c) for c in ("accessionNumber", "primaryDocument", "filingDate", "acceptanceDateTime")])
    flat = pages.select(body.alias("b")).select(F.col("b.cik").alias("cik"), F.inline(zipped))
    published = F.coalesce(F.try_to_timestamp("acceptanceDateTime"), publication_instant(F.col("filingDate").cast("date"), "America/New_York"))
    path = F.concat_ws("/", F.lit("data"), F.regexp_replace("cik", "^0+(?=.)", ""), F.replace(F.col("accessionNumber"), F.lit("-"), F.lit("")), "primaryDocument")
    return flat.select("cik", "accessionNumber", "filingDate", published.alias("published"), path.alias("path"))


def _at(v: Column, path: str, kind: str = "string") -> Column:
    """A field of a variant, null where it is not there, is null or is of another kind."""
    return F.try_variant_get(v, path, kind)


def indicators(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """([header, rows] pages of an indicator as rows, faulty rows as (row, fault)).

    A null value stays a row with a null; a row without the field, with a value that is no number, or without indicator, country or date is faulty, and
    so is a page without rows. period by year, month or day."""
    rows = _at(F.try_parse_json("body"), "$[1]", "array<variant>")
    flat = pages.select(F.explode(F.coalesce(rows, F.array(F.lit(None).cast("variant")))).alias("r"))
    value = _at(F.col("r"), "$.value", "variant")
    names = [_at(F.col("r"), f"$.{c}") for c in ("indicator.id", "country.id", "date")]
    known = names[0].isNotNull() & names[1].isNotNull() & names[2].isNotNull()
    bad = F.is_variant_null(value) | _at(value, "$", "double").isNotNull()
    fault = F.when(F.col("r").isNull(), "no_rows").when(~known, "no_identity").when(value.isNull(), "no_value_field").when(~bad, "not_a_number")
    checked = flat.withColumn("fault", fault)
    good = checked.where("fault is null").select(
        F.concat_ws(":", F.lit("WB"), *names[:2]).alias("series_id"), period_start(names[2]).alias("period_start"), period_end(names[2]).alias("period_end"), _at(F.col("r"), "$.value", "double").alias("value")
    )
    return good, checked.where("fault is not null").select(F.to_json("r").alias("row"), "fault")


def page_gaps(pages: DataFrame) -> DataFrame:
    """Sources whose pages are not all there or whose rows differ from the advertised total."""
    head = F.from_json(F.get_json_object("body", "$[0]"), "struct<page:int,pages:int,total:long>")
    rows = F.json_array_length(F.get_json_object("body", "$[1]"))
    g = pages.select("source", head.alias("h"), rows.alias("n")).groupBy("source").agg(F.count_distinct("h.page").alias("seen"), F.count("*").alias("fetched"), F.max("h.pages").alias("pages"), F.max("h.total").alias("total"), F.sum("n").alias("rows"))
    return g.where((F.col("seen") != F.col("pages")) | (F.col("fetched") != F.col("pages")) | (F.col("rows") != F.col("total")))


def statistics_rows(raw: DataFrame) -> DataFrame:
    """Rows (series_id, year, period, value as text) of a tab-separated file: M01-M12 to months, M13 to the annual average under
    its own series, suppressed cells to null."""
    month = F.regexp_extract("period", r"^M(\d\d)$", 1).try_cast("int")
    first = F.when(month == 13, F.concat(F.trim("year"), F.lit(""))).otherwise(F.concat_ws("-", F.trim("year"), F.lpad(month.cast("string"), 2, "0")))
    known = raw.where(month.between(1, 13))
    series = F.when(month == 13, F.concat(F.trim("series_id"), F.lit(":annual"))).otherwise(F.trim("series_id"))
    return known.select(series.alias("series_id"), period_start(first).alias("period_start"), period_end(first).alias("period_end"), clean_number(F.col("value")).alias("value"))


def header_table(pages: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """(data rows of an array of arrays whose first is the header, faulty rows as (row, fault)): the named columns as text.

    A row of another width than its header is faulty, and so is a page without one of the columns."""
    rows = F.from_json("body", "array<array<string>>")
    flat = pages.select(rows.alias("r")).select(F.col("r")[0].alias("head"), F.explode(F.slice("r", 2, F.greatest(F.lit(0), F.size("r") - 1))).alias("row"))
    there = F.size(F.array_intersect("head", F.array(*map(F.lit, columns)))) == len(set(columns))
    fault = F.when(~F.coalesce(there, F.lit(False)), "column_missing").when(F.coalesce(F.size("row"), F.lit(-1)) != F.size("head"), "width")
    checked = flat.withColumn("fault", fault)
    good = checked.where("fault is null").select(*[F.try_element_at("row", F.array_position("head", F.lit(c)).cast("int")).alias(c) for c in columns])
    return good, checked.where("fault is not null").select("row", "fault")


#: What stands for a withheld trade value.
SUPPRESSED = ("", "null", "N", "S", "-", "(S)")


def trade_values(pages: DataFrame, direction: str, code: str, title: str, measure: str) -> tuple[DataFrame, DataFrame]:
    """Trade tables (body, month) to observations in USD by commodity and partner, and faulty rows as (row, fault).

    code, title, measure: names of the columns of the commodity's code and title and of the value; partners are CTY_CODE and CTY_NAME. Suppressed values are null; a
    value that is no number, and a row without code or partner, is faulty."""
    month = F.to_date(F.concat("month", F.lit("-01")))
    # tables of one month share their header check; the month goes along as a first column
    rows = F.from_json("body", "array<array<string>>")
    dated = F.transform(rows, lambda r, i: F.concat(F.array(F.when(i == 0, "__month").otherwise(F.date_format(month, "yyyy-MM-dd"))), r))
    good, bad = header_table(pages.select(F.to_json(dated).alias("body")), ["__month", code, title, "CTY_CODE", "CTY_NAME", measure])
    raw = F.coalesce(F.col(measure), F.lit(""))
    value = F.when(~raw.isin(*SUPPRESSED), raw.try_cast("double"))
    fault = F.when(F.col(code).isNull() | F.col("CTY_CODE").isNull(), "no_identity").when(~raw.isin(*SUPPRESSED) & (value.isNull() | F.isnan(value)), "not_a_number")
    checked = good.withColumn("fault", fault)
    told = checked.where("fault is null").select(
        F.concat_ws(":", F.lit("CENSUS"), F.lit(direction), "CTY_CODE", code, F.lit(measure)).alias("series_id"), F.coalesce(title, code).alias("title"), F.col("CTY_NAME").alias("country"),
        F.col("__month").cast("date").alias("period_start"), F.last_day(F.col("__month").cast("date")).alias("period_end"), value.alias("value"), F.lit("USD").alias("unit"),
        F.create_map(F.lit("direction"), F.lit(direction), F.lit("hs_code"), F.col(code), F.lit("reporter"), F.lit("USA"), F.lit("partner"), F.col("CTY_CODE"), F.lit("measure"), F.lit(measure)).alias("dimensions"),
    )
    row = F.array("__month", code, title, "CTY_CODE", "CTY_NAME", measure)
    return told, bad.unionByName(checked.where("fault is not null").select(row.alias("row"), "fault"))


def facets(pages: DataFrame, route: str, fields: list[str], keys: list[str]) -> DataFrame:
    """Wide rows with a period, facets and several numeric fields to one observation for each field; series route:field:hash of facets."""
    rows = F.from_json("body", "struct<response:struct<data:array<map<string,string>>>>")
    flat = pages.select(F.explode(rows["response"]["data"]).alias("m")).select("m", F.explode(F.array(*map(F.lit, fields))).alias("field"))
    facet = F.to_json(F.map_filter("m", lambda k, v: k.isin(*sorted(keys))))
    at = lambda k: F.try_element_at("m", k)
    series = F.concat_ws(":", F.lit(route), "field", F.substring(F.sha2(facet, 256), 1, 16))
    return flat.select(series.alias("series_id"), period_start(at(F.lit("period"))).alias("period_start"), period_end(at(F.lit("period"))).alias("period_end"), clean_number(at(F.col("field"))).alias("value"), at(F.concat(F.col("field"), F.lit("-units"))).alias("unit"))


def route_catalogue(pages: DataFrame) -> DataFrame:
    """A listing's child routes, and for a leaf each frequency with its range."""
    b = F.from_json("body", "struct<response:struct<id:string,routes:array<struct<id:string>>,frequency:array<struct<id:string>>,startPeriod:string,endPeriod:string>>")["response"]
    r = pages.select(b.alias("r"))
    children = r.select(F.col("r.id").alias("route"), F.explode("r.routes").alias("c")).select("route", F.lit("child").alias("kind"), F.col("c.id").alias("name"), F.lit(None).cast("date").alias("first"), F.lit(None).cast("date").alias("last"))
    leaves = r.select(F.col("r.id").alias("route"), F.explode("r.frequency").alias("c"), "r").select("route", F.lit("frequency").alias("kind"), F.col("c.id").alias("name"), period_start(F.col("r.startPeriod")).alias("first"), period_end(F.col("r.endPeriod")).alias("last"))
    return children.unionByName(leaves)


def input_output(pages: DataFrame, name: str) -> DataFrame:
    """Cells of an input-output table: series name:row:column with the matrix dimensions."""
    rows = F.from_json("body", "struct<Data:array<struct<Year:string,RowCode:string,ColCode:string,DataValue:string>>>")["Data"]
    flat = pages.select(F.inline(rows))
    return flat.select(F.concat_ws(":", F.lit(name), "RowCode", "ColCode").alias("series_id"), F.create_map(F.lit("row"), "RowCode", F.lit("column"), "ColCode").alias("dimensions"), period_start(F.col("Year")).alias("period_start"), period_end(F.col("Year")).alias("period_end"), clean_number(F.col("DataValue")).alias("value"))


#: Months as the release pages write them.
MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")


def release_figure(pages: DataFrame) -> DataFrame:
    """S24: "<Month> <Year> ... Revenue ... NT$ <n> Million" of the description, published at the end of the first date of the page
    (YYYY/MM/DD) at or after the month, in Taipei."""
    said = F.regexp_extract("html", r'(?i)<meta[^>]*name="description"[^>]*content="([^"]*)"', 1)
    pattern = r"(" + "|".join(MONTHS) + r")\s+(\d{4})\s+Revenue.*?NT\$\s*([\d,]+)\s*Million"
    month = F.array_position(F.array(*map(F.lit, MONTHS)), F.regexp_extract(said, pattern, 1))
    first = F.make_date(F.regexp_extract(said, pattern, 2).try_cast("int"), F.nullif(month, F.lit(0)).cast("int"), F.lit(1))
    dates = F.transform(F.regexp_extract_all("html", F.lit(r"(\d{4}/\d{2}/\d{2})")), lambda d: F.to_date(d, "yyyy/MM/dd"))
    rows = pages.withColumn("period_start", F.when(month > 0, first)).where("period_start is not null").withColumn("dates", dates)
    rows = rows.withColumn("day", F.array_min(F.filter("dates", lambda d: d >= F.col("period_start"))))
    return rows.select("url", "period_start", F.last_day("period_start").alias("period_end"), (clean_number(F.regexp_extract(said, pattern, 3)) * 1e6).alias("value"), publication_instant(F.col("day"), "Asia/Taipei").alias("published"))


#: Attribute values in double quotes, single quotes or none.
HREF = r"""(?i)<a\s(?:[^>]*?\s)?href\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""


def plain_path(path: Column) -> Column:
    """A path from its first slash without "." and ".." segments; ".." above the root is dropped."""
    part = F.split(path, "/")
    kept = F.aggregate(
        F.slice(part, 2, F.greatest(F.lit(0), F.size(part) - 1)), F.array().cast("array<string>"),
        lambda acc, s: F.when(s == "..", F.slice(acc, 1, F.greatest(F.lit(0), F.size(acc) - 1))).when(s == ".", acc).otherwise(F.concat(acc, F.array(s))),
    )
    folder = F.element_at(part, -1).isin(".", "..") & (F.size(kept) > 0)  # what ends in a dot segment is a folder
    return F.concat(F.lit("/"), F.array_join(kept, "/"), F.when(folder, "/").otherwise(""))


def links(pages: DataFrame, key: str) -> DataFrame:
    """(key, link, same_host) of every a[href], made absolute against the page's URL, without fragment, each once.

    Values stand in double quotes, single quotes or none; "." and ".." segments are resolved; what has another scheme than http(s), and
    fragments alone, are left out."""
    root = F.regexp_extract("url", r"^(https?://[^/?#]+)", 1)
    folder = F.regexp_extract("url", r"^https?://[^/?#]+(/(?:[^?#]*/)?)", 1)
    href = F.trim("href")
    absolute = (
        F.when(href.rlike("^(?i)https?://"), href).when(href.startswith("//"), F.concat(F.regexp_extract("url", "^(https?)://", 1), F.lit(":"), href)).when(href.startswith("/"), F.concat(root, href))
        .when(href.startswith("#") | href.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:") | (href == ""), F.lit(None)).otherwise(F.concat(root, F.when(folder == "", "/").otherwise(folder), href))
    )
    tags = F.regexp_extract_all("html", F.lit(HREF), 0)
    value = F.coalesce(*[F.nullif(F.regexp_extract("tag", HREF, k), F.lit("")) for k in (1, 2, 3)])
    flat = pages.select(key, "url", F.explode(tags).alias("tag")).withColumn("href", value)
    found = flat.select(key, root.alias("root"), F.regexp_replace(absolute, "#.*$", "").alias("link")).where("link is not null")
    own, rest = F.regexp_extract("link", r"^((?i)https?://[^/?#]+)", 1), F.regexp_extract("link", r"^(?i)https?://[^/?#]+(/[^?#]*)", 1)
    after = F.regexp_extract("link", r"^(?i)https?://[^/?#]+[^?#]*([?#].*)?$", 1)
    resolved = F.when(rest.rlike(r"/\.\.?(/|$)"), F.concat(own, plain_path(rest), after)).otherwise(F.col("link"))
    return found.select(key, resolved.alias("link"), (own == F.col("root")).alias("same_host")).distinct()


def joined(base: Column, href: Column) -> Column:
    """An address against the page it stands on; what has a scheme stays, "." and ".." segments are resolved."""
    root = F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]+)", 1)
    folder = F.regexp_extract(base, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]+(/(?:[^?#]*/)?)", 1)
    own = (
        F.when(href.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:"), href).when(href.startswith("//"), F.concat(F.regexp_extract(base, "^([^:]+:)", 1), href)).when(href.startswith("/"), F.concat(root, href))
        .when(href.startswith("?") | href.startswith("#"), F.concat(F.regexp_extract(base, "^([^?#]*)", 1), href)).otherwise(F.concat(root, F.when(folder == "", "/").otherwise(folder), href))
    )
    host, path = F.regexp_extract(own, r"^([^/?#]+://[^/?#]+)", 1), F.regexp_extract(own, r"^[^/?#]+://[^/?#]+(/[^?#]*)", 1)
    return F.when(path.rlike(r"/\.\.?(/|$)"), F.concat(host, plain_path(path), F.regexp_extract(own, r"([?#].*)$", 1))).otherwise(own)


def _text(v: Column, path: str) -> Column:
    """A string field, or the strings of an array joined; else empty."""
    return F.coalesce(_string(v, path), F.array_join(F.array_compact(F.transform(_at(v, path, "array<variant>"), lambda x: _string(x, "$"))), ", "), F.lit(""))


def _string(v: Column, path: str) -> Column:
    """A field that is a string in the document; numbers and objects do not count."""
    return F.when(F.schema_of_variant(_at(v, path, "variant")) == "STRING", _at(v, path))


def _json(v: Column, path: str) -> Column:
    """A part of the document as JSON; null where it is not there or null."""
    part = _at(v, path, "variant")
    return F.when(part.isNotNull() & ~F.is_variant_null(part), F.to_json(part))


def _first(items: Column, keep) -> Column:
    return F.try_element_at(F.filter(items, keep), F.lit(1))


_PART = "array<struct<url:string,media_type:string,format:string>>"
_DATASET = ("url", "protocol", "external_id", "title", "description", "landing", "license", "spatial", "temporal", "keywords", "distributions")


def _parts(base: Column, items: Column, address, media: str, form: str | None) -> Column:
    """Distributions of those items that have an address."""
    struct = lambda x: F.struct(joined(base, address(x)).alias("url"), _string(x, media).alias("media_type"), (_string(x, form) if form else F.lit(None).cast("string")).alias("format"))
    return F.coalesce(F.transform(F.filter(items, lambda x: address(x).isNotNull()), struct), F.array().cast(_PART)).cast(_PART)


def _flow(where: str) -> Column:
    return F.coalesce(F.col(f"x.{where}Dataflows.Dataflow"), F.array().cast(_FLOW))


_FLOW = "array<struct<_id:string,_agencyID:string,_version:string,Name:array<string>>>"
_STRUCTURE = f"struct<Dataflows:struct<Dataflow:{_FLOW}>,Structures:struct<Dataflows:struct<Dataflow:{_FLOW}>>>"


def catalog_entries(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(datasets of catalogue documents (url, protocol, body), documents without a list of entries, or with an entry without id).

    Protocols: ckan, stac, ogc, dcat and jsonld (entries whose type ends in Dataset), openapi (each path with a GET), sdmx (JSON or XML in any namespaces). A dataset
    has external_id, title (else the id), description, landing, license, spatial and temporal extent as JSON, keywords and distributions (url,
    media_type, format). Addresses are absolute. Documents are parsed once, to a variant, so a missing field and a null can be told apart."""
    d = documents.withColumn("v", F.try_parse_json("body")).withColumn("x", F.when((F.col("protocol") == "sdmx") & F.ltrim("body").startswith("<"), F.from_xml("body", _STRUCTURE, {"ignoreNamespace": "true"})))
    v, url, kind = F.col("v"), F.col("url"), F.col("protocol")
    every = lambda path: _at(v, path, "array<variant>")
    whole = F.array(v)
    own = F.when(_at(v, "$.type") == "Collection", whole).otherwise(F.array().cast("array<variant>"))
    stac = F.when(v.isNotNull(), F.concat(own, F.coalesce(every("$.collections"), F.array().cast("array<variant>"))))
    graph = F.when(v.isNotNull(), F.coalesce(every("$['@graph']"), whole))
    paths = F.when(_at(v, "$.openapi", "variant").isNotNull() | _at(v, "$.swagger", "variant").isNotNull(), _at(v, "$.paths", "map<string,variant>"))
    entries = (
        F.when((kind == "ckan") & (_at(v, "$.success", "boolean")), every("$.result.results")).when(kind == "stac", stac).when(kind == "ogc", every("$.collections"))
        .when(kind.isin("dcat", "jsonld"), graph).when(kind == "sdmx", F.coalesce(every("$.data.dataflows"), every("$.dataflows")))
    )
    flows = F.when(F.col("x").isNotNull(), F.filter(F.concat(_flow(""), _flow("Structures.")), lambda f: f["_id"].isNotNull()))
    d = d.withColumn("entries", entries).withColumn("paths", F.when(kind == "openapi", paths)).withColumn("flows", F.when(F.size(flows) > 0, flows))
    e = F.col("e")
    typed = F.coalesce(_at(e, "$['@type']", "array<string>"), F.array(_at(e, "$['@type']")))
    dataset = ~kind.isin("dcat", "jsonld") | F.exists(typed, lambda s: F.coalesce(s.endswith("Dataset"), F.lit(False)))
    linked = kind.isin("dcat", "jsonld")
    name = F.when(linked, F.coalesce(_string(e, "$['@id']"), _string(e, "$.identifier"), _string(e, "$.name"), F.lit("dataset"))).otherwise(_string(e, "$.id"))
    flat = d.select("url", "protocol", "body", F.explode("entries").alias("e")).where(dataset).withColumn("external_id", name)
    title = F.when(linked | (kind == "sdmx"), _string(e, "$.name")).otherwise(_string(e, "$.title"))
    links = _at(e, "$.links", "array<variant>")
    self_link = _string(_first(links, lambda x: _at(x, "$.rel") == "self"), "$.href")
    landing = F.when(kind.isin("ckan", "dcat", "jsonld"), joined(url, _string(e, "$.url"))).when(kind.isin("stac", "ogc"), joined(url, self_link))
    license = F.when(kind == "ckan", _string(e, "$.license_title")).when(kind.isin("stac", "dcat", "jsonld"), _string(e, "$.license"))
    spatial = F.when(kind == "ckan", _json(e, "$.spatial")).when(kind.isin("stac", "ogc"), _json(e, "$.extent.spatial")).when(linked, _json(e, "$.spatialCoverage"))
    dates = F.to_json(F.struct(_at(e, "$.metadata_created").alias("metadata_created"), _at(e, "$.metadata_modified").alias("metadata_modified")), {"ignoreNullFields": "false"})
    temporal = F.when(kind == "ckan", dates).when(kind.isin("stac", "ogc"), _json(e, "$.extent.temporal")).when(linked, _json(e, "$.temporalCoverage"))
    tags = F.transform(_at(e, "$.tags", "array<variant>"), lambda x: F.coalesce(_string(x, "$.display_name"), _string(x, "$.name")))
    keywords = F.array_compact(F.coalesce(F.when(kind == "ckan", tags).when(kind == "stac", _at(e, "$.keywords", "array<string>")), F.array().cast("array<string>")))
    assets = F.map_values(_at(e, "$.assets", "map<string,variant>"))
    offered = (
        F.when(kind == "ckan", _parts(url, _at(e, "$.resources", "array<variant>"), lambda x: _string(x, "$.url"), "$.mimetype", "$.format"))
        .when(kind == "stac", _parts(url, assets, lambda x: _string(x, "$.href"), "$.type", None))
        .when(linked, _parts(url, _at(e, "$.distribution", "array<variant>"), lambda x: F.coalesce(_string(x, "$.contentUrl"), _string(x, "$.accessURL")), "$.encodingFormat", "$.format"))
        .otherwise(F.array().cast(_PART))
    )
    described = F.when(kind == "ckan", _text(e, "$.notes")).otherwise(_text(e, "$.description"))
    told = flat.where("external_id is not null").select("url", "protocol", "external_id", F.coalesce(title, "external_id").alias("title"), described.alias("description"), landing.alias("landing"), license.alias("license"), spatial.alias("spatial"), temporal.alias("temporal"), keywords.alias("keywords"), offered.alias("distributions"))
    none, nothing = F.lit(None).cast("string"), F.array().cast(_PART)
    g = F.col("g")
    api = d.select("url", "protocol", "v", F.explode("paths").alias("path", "methods")).withColumn("g", _at(F.col("methods"), "$.get", "variant")).where("g is not null").select(
        "url", "protocol", F.concat(F.lit("GET "), "path").alias("external_id"), F.coalesce(_string(g, "$.summary"), _string(g, "$.operationId"), "path").alias("title"), _text(g, "$.description").alias("description"), joined(url, F.col("path")).alias("landing"),
        _string(v, "$.info.license.name").alias("license"), none.alias("spatial"), none.alias("temporal"), F.array_compact(F.coalesce(_at(g, "$.tags", "array<string>"), F.array().cast("array<string>"))).alias("keywords"), nothing.alias("distributions"),
    )
    xml = d.select("url", "protocol", F.inline("flows")).select(
        "url", "protocol", F.col("_id").alias("external_id"), F.coalesce(F.try_element_at("Name", F.lit(1)), "_id").alias("title"), F.lit("").alias("description"), url.alias("landing"),
        none.alias("license"), none.alias("spatial"), none.alias("temporal"), F.array().cast("array<string>").alias("keywords"), nothing.alias("distributions"),
    )
    # an entry without id spoils its document, but in SDMX, where it is passed over
    nameless = flat.where((kind != "sdmx") & F.col("external_id").isNull()).select("url", "protocol", "body").distinct()
    empty = d.where(F.col("entries").isNull() & F.col("paths").isNull() & F.col("flows").isNull()).select(*documents.columns)
    spoilt = documents.join(nameless, ["url", "protocol", "body"], "left_semi").select(*documents.columns)
    clean = told.join(nameless.select("url", "protocol"), ["url", "protocol"], "left_anti")
    return clean.select(*_DATASET).unionByName(api).unionByName(xml), empty.unionByName(spoilt)


def catalog_links(documents: DataFrame) -> DataFrame:
    """(url, follow) of the child, collection and data links of STAC documents, absolute and each once."""
    v = F.try_parse_json("body")
    links = documents.where(F.col("protocol") == "stac").select("url", F.explode(_at(v, "$.links", "array<variant>")).alias("l"))
    wanted = links.where(_at(F.col("l"), "$.rel").isin("child", "collection", "data") & _string(F.col("l"), "$.href").isNotNull())
    return wanted.select("url", joined(F.col("url"), _string(F.col("l"), "$.href")).alias("follow")).distinct()


def catalog_totals(documents: DataFrame) -> DataFrame:
    """(url, total) that a document states or, for whole listings, holds."""
    v, kind = F.try_parse_json("body"), F.col("protocol")
    count = F.when(kind == "ckan", _at(v, "$.result.count", "long")).when(kind == "ogc", F.size(_at(v, "$.collections", "array<variant>")).cast("long"))
    flows = F.coalesce(_at(v, "$.data.dataflows", "array<variant>"), _at(v, "$.dataflows", "array<variant>"))
    return documents.select("url", F.coalesce(count, F.when(kind == "sdmx", F.nullif(F.size(flows), F.lit(-1)).cast("long"))).alias("total"))


#: Headers that name a period, a value and a unit, in any case.
RECOGNISED = {"period": ("ref_date", "date", "period", "time"), "value": ("value",), "unit": ("uom", "unit")}


def recognised(columns: list[str]) -> dict[str, str | None]:
    """The first column of each kind that RECOGNISED names; null where there is none."""
    return {kind: next((c for c in columns if c.lower() in names), None) for kind, names in RECOGNISED.items()}


def profile(cells: DataFrame) -> DataFrame:
    """For each column of text: rows, missing cells, numeric cells, whether all that is there is numeric, and what the header is recognised as; one pass.

    Numbers are finite and stand without spaces around them."""
    kinds, parts = {c: k for k, c in recognised(cells.columns).items() if c}, []
    for c in cells.columns:
        empty = F.col(c).isNull() | (F.trim(c) == "")
        number = F.when(F.col(c).rlike(r"^\S+$"), F.col(c).try_cast("double"))
        finite = number.isNotNull() & ~F.isnan(number) & (F.abs(number) != float("inf"))
        parts.append(F.struct(F.lit(c).alias("name"), F.lit(kinds.get(c)).cast("string").alias("recognised"), F.count_if(empty).alias("missing"), F.count_if(finite).alias("numeric"), F.count("*").alias("rows")))
    flat = cells.agg(F.array(*parts).alias("p")).select(F.inline("p"))
    return flat.withColumn("all_numeric", F.col("numeric") == F.col("rows") - F.col("missing"))


def csv_observations(cells: DataFrame, dataset: str, period: str, value: str, unit: str) -> DataFrame:
    """Rows of text with recognised period, value and unit columns to observations; the others are dimensions, in the series key.

    A cell that is neither a number nor suppressed raises."""
    from pitlake.functions.scalars import bad_number

    rest = sorted(c for c in cells.columns if c not in (period, value, unit))
    pairs = F.map_from_arrays(F.array(*map(F.lit, rest)), F.array(*[F.col(c) for c in rest])) if rest else F.create_map().cast("map<string,string>")
    dims = F.map_filter(pairs, lambda _, v: v.isNotNull() & (v != ""))
    checked = F.when(bad_number(F.col(value)), F.raise_error(F.concat(F.lit("not a number: "), F.col(value))).cast("double")).otherwise(clean_number(F.col(value)))
    key = F.sha2(F.concat_ws("\0", F.lit(dataset), F.coalesce(F.col(unit), F.lit("")), F.to_json(dims)), 256)
    return cells.select(key.alias("series_id"), dims.alias("dimensions"), period_start(F.col(period)).alias("period_start"), period_end(F.col(period)).alias("period_end"), checked.alias("value"), F.col(unit).alias("unit"))


def relevance(rows: DataFrame, text: Column, query: str, key: str, most: int) -> DataFrame:
    """The rows of highest 0.65 x share of the query's words found + 0.35 x provenance - 0.1 x cost, within 0 to 1.

    Words are runs of letters and digits longer than one; ties by the key."""
    import re

    words = [w for w in re.split(r"[^0-9A-Za-z]+", query.lower()) if len(w) > 1]
    low = F.lower(text)
    share = sum((F.contains(low, F.lit(w)).cast("int") for w in words), F.lit(0)) / max(1, len(words))
    score = F.least(F.lit(1.0), F.greatest(F.lit(0.0), 0.65 * share + 0.35 * F.col("provenance") - 0.1 * F.col("cost")))
    return rows.withColumn("score", score).orderBy(F.desc("score"), key).limit(most)
