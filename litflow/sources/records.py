"""Landed payloads to paper records: RSS, Atom, scholar JSON, PubMed XML, arXiv Atom.

Every format has a declared record schema and one projection. Records come either from files
(``read_*``: the built-in xml/json sources, batch or streaming) or from a string column
(``parse_*``: ``from_xml`` / ``from_json``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from litflow.functions import text as tx

# Names of common arXiv categories.
ARXIV_CATEGORIES = {
    "cs.AI": "Artificial Intelligence", "cs.CL": "Computation and Language",
    "cs.CV": "Computer Vision and Pattern Recognition", "cs.LG": "Machine Learning",
    "cs.NE": "Neural and Evolutionary Computing", "cs.RO": "Robotics", "cs.SE": "Software Engineering",
    "physics.chem-ph": "Chemical Physics", "physics.comp-ph": "Computational Physics",
    "physics.bio-ph": "Biological Physics", "cond-mat": "Condensed Matter", "quant-ph": "Quantum Physics",
    "math.ST": "Statistics Theory", "stat.ML": "Machine Learning (Statistics)",
    "q-bio": "Quantitative Biology", "econ": "Economics", "q-fin": "Quantitative Finance",
}
# Month names of the wire format.
MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")

_LINK = "ARRAY<STRUCT<_href: STRING, _rel: STRING, _title: STRING>>"
RSS_SCHEMA = """
`title` STRING, `link` ARRAY<STRING>, `description` STRING, `summary` STRING, `dc:description` STRING,
`author` STRING, `dc:creator` ARRAY<STRING>, `dc:identifier` STRING, `prism:doi` STRING, `doi` STRING,
`prism:publicationName` STRING, `pubDate` STRING, `dc:date` STRING, `prism:publicationDate` STRING, `guid` STRING
"""
ATOM_SCHEMA = f"""
`title` STRING, `link` {_LINK}, `summary` STRING, `content` STRING, `author` ARRAY<STRUCT<name: STRING>>,
`published` STRING, `updated` STRING, `dc:identifier` STRING, `prism:doi` STRING, `doi` STRING,
`prism:publicationName` STRING, `id` STRING
"""
SCHOLAR_SCHEMA = """
paperId STRING, externalIds MAP<STRING, STRING>, title STRING, abstract STRING, url STRING, venue STRING, year INT,
publicationDate STRING, citationCount INT, influentialCitationCount INT, authors ARRAY<STRUCT<name: STRING>>,
s2FieldsOfStudy ARRAY<STRUCT<category: STRING>>
"""
PUBMED_SCHEMA = """
MedlineCitation STRUCT<
  PMID: STRUCT<_VALUE: STRING, _Version: STRING>,
  Article: STRUCT<
    ArticleTitle: STRING,
    Abstract: STRUCT<AbstractText: ARRAY<STRUCT<_VALUE: STRING, _Label: STRING>>>,
    AuthorList: STRUCT<Author: ARRAY<STRUCT<LastName: STRING, ForeName: STRING>>>,
    Journal: STRUCT<Title: STRING, JournalIssue: STRUCT<PubDate: STRUCT<Year: STRING, Month: STRING, Day: STRING>>>>,
  MeshHeadingList: STRUCT<MeshHeading: ARRAY<STRUCT<DescriptorName: STRUCT<_VALUE: STRING, _UI: STRING>>>>>,
PubmedData STRUCT<ArticleIdList: STRUCT<ArticleId: ARRAY<STRUCT<_VALUE: STRING, _IdType: STRING>>>>
"""
ARXIV_SCHEMA = f"""
`id` STRING, `title` STRING, `summary` STRING, `published` STRING, `updated` STRING, `author` ARRAY<STRUCT<name: STRING>>,
`category` ARRAY<STRUCT<_term: STRING>>, `arxiv:doi` STRING, `arxiv:journal_ref` STRING, `link` {_LINK}
"""
# Inline elements of titles and abstracts; their tags are dropped, their text stays.
INLINE_MARKUP = r"</?(?:i|b|u|em|strong|italic|bold|sub|sup|DispFormula|mml:[A-Za-z]+)(?:\s[^>]*)?/?>"
ROW_TAGS = {"rss": "item", "atom": "entry", "pubmed": "PubmedArticle", "arxiv": "entry"}
SCHEMAS = {
    "rss": RSS_SCHEMA, "atom": ATOM_SCHEMA, "pubmed": PUBMED_SCHEMA, "arxiv": ARXIV_SCHEMA, "scholar": SCHOLAR_SCHEMA,
}


def _names(c: Column) -> Column:
    return F.filter(F.transform(c, lambda a: a["name"]), lambda n: n.isNotNull() & (n != ""))


def _texts(c: Column) -> Column:
    return F.coalesce(c, F.array().cast("array<string>"))


def _paper(kind: str, **given: Column) -> list[Column]:
    """All paper columns; those a source does not deliver are NULL."""
    types = {
        "title": "string", "url": "string", "abstract": "string", "authors": "array<string>", "doi": "string",
        "arxiv_id": "string", "semantic_scholar_id": "string", "pubmed_id": "string", "journal": "string",
        "venue": "string", "published_date": "timestamp", "year": "int", "citation_count": "int",
        "influential_citation_count": "int", "fields_of_study": "array<string>",
    }
    cols = [given.get(n, F.lit(None)).cast(t).alias(n) for n, t in types.items()]
    return [*cols, F.lit(kind).alias("source_type")]


def _rss(r: Column, journal: Column | None) -> list[Column]:
    links = _texts(F.filter(r["link"], lambda x: x.isNotNull()))
    plain = F.get(links, F.lit(0))
    own = r["prism:publicationName"]
    return _paper(
        "rss",
        title=F.coalesce(r["title"], F.lit("Untitled")),
        url=F.coalesce(tx.preferred_url(plain, links), F.lit("")),
        abstract=tx.usable_abstract(r["summary"], r["description"], r["dc:description"]),
        authors=tx.first_nonempty_authors(F.array_compact(F.array(r["author"])), r["dc:creator"]),
        doi=tx.extract_doi([r["dc:identifier"], r["prism:doi"], r["doi"]], links),
        journal=own if journal is None else F.coalesce(tx.blank_to_null(own), journal),
        published_date=F.coalesce(*[tx.parse_date(r[c]) for c in ("pubDate", "dc:date", "prism:publicationDate")]),
    )


def _atom(r: Column, journal: Column | None) -> list[Column]:
    links = _texts(F.transform(r["link"], lambda x: x["_href"]))
    own = r["prism:publicationName"]
    return _paper(
        "rss",
        title=F.coalesce(r["title"], F.lit("Untitled")),
        url=F.coalesce(tx.preferred_url(F.get(links, F.lit(0)), links), F.lit("")),
        abstract=tx.usable_abstract(r["summary"], r["content"]),
        authors=_texts(_names(r["author"])),
        doi=tx.extract_doi([r["dc:identifier"], r["prism:doi"], r["doi"]], links),
        journal=own if journal is None else F.coalesce(tx.blank_to_null(own), journal),
        published_date=F.coalesce(tx.parse_date(r["published"]), tx.parse_date(r["updated"])),
    )


def _scholar(r: Column, journal: Column | None) -> list[Column]:
    ids = r["externalIds"]
    return _paper(
        "semantic_scholar",
        title=F.coalesce(r["title"], F.lit("Untitled")),
        url=F.coalesce(
            tx.blank_to_null(r["url"]),
            F.concat(F.lit("https://www.semanticscholar.org/paper/"), F.coalesce(r["paperId"], F.lit(""))),
        ),
        abstract=r["abstract"], authors=_texts(_names(r["authors"])),
        doi=F.try_element_at(ids, F.lit("DOI")), arxiv_id=F.try_element_at(ids, F.lit("ArXiv")),
        pubmed_id=F.try_element_at(ids, F.lit("PubMed")), semantic_scholar_id=r["paperId"],
        journal=r["venue"], venue=r["venue"],
        published_date=F.try_to_timestamp(r["publicationDate"], F.lit("yyyy-MM-dd")), year=r["year"],
        citation_count=r["citationCount"], influential_citation_count=r["influentialCitationCount"],
        fields_of_study=_texts(F.filter(
            F.transform(r["s2FieldsOfStudy"], lambda f: f["category"]), lambda c: c.isNotNull() & (c != ""))),
    )


def _pubmed(r: Column, journal: Column | None) -> list[Column]:
    m = r["MedlineCitation"]
    art = m["Article"]
    parts = F.transform(
        art["Abstract"]["AbstractText"],
        lambda p: F.when(F.coalesce(p["_Label"], F.lit("")) != "", F.concat(p["_Label"], F.lit(": "), F.coalesce(p["_VALUE"], F.lit(""))))
        .otherwise(F.coalesce(p["_VALUE"], F.lit(""))),
    )
    people = F.filter(art["AuthorList"]["Author"], lambda a: F.coalesce(a["LastName"], F.lit("")) != "")
    d = art["Journal"]["JournalIssue"]["PubDate"]
    named = F.array_position(F.array(*[F.lit(x) for x in MONTHS]), F.coalesce(d["Month"], F.lit("")))
    month = F.when(named > 0, F.lpad(named.cast("string"), 2, "0")).otherwise(F.lpad(F.coalesce(d["Month"], F.lit("01")), 2, "0"))
    day = F.lpad(F.coalesce(d["Day"], F.lit("01")), 2, "0")

    def date(day_of_month: Column) -> Column:
        return F.try_to_timestamp(F.concat_ws("-", d["Year"], month, day_of_month), F.lit("yyyy-MM-dd"))

    published = F.when(d["Year"].isNotNull(), F.coalesce(date(day), date(F.lit("01"))))
    doi = F.get(F.filter(r["PubmedData"]["ArticleIdList"]["ArticleId"], lambda x: x["_IdType"] == "doi"), F.lit(0))
    pmid = m["PMID"]["_VALUE"]
    return _paper(
        "pubmed",
        title=F.coalesce(art["ArticleTitle"], F.lit("Untitled")),
        url=F.when(pmid.isNotNull(), F.concat(F.lit("https://pubmed.ncbi.nlm.nih.gov/"), pmid, F.lit("/"))).otherwise(F.lit("")),
        abstract=F.when(art["Abstract"].isNotNull(), F.array_join(parts, " ")),
        authors=_texts(F.transform(people, lambda a: tx.strip(F.concat_ws(" ", a["ForeName"], a["LastName"])))),
        doi=doi["_VALUE"], pubmed_id=pmid, journal=art["Journal"]["Title"],
        published_date=published, year=F.year(published),
        fields_of_study=_texts(F.filter(
            F.transform(m["MeshHeadingList"]["MeshHeading"], lambda h: h["DescriptorName"]["_VALUE"]), lambda t: t.isNotNull())),
    )


def arxiv_id(entry_id: Column) -> Column:
    found = tx.blank_to_null(F.regexp_extract(entry_id, r"arxiv.org/abs/([^v]+)", 1))
    return F.coalesce(found, F.substring_index(F.substring_index(entry_id, "/", -1), "v", 1))


def _arxiv(r: Column, journal: Column | None) -> list[Column]:
    names = F.create_map(*[F.lit(x) for kv in ARXIV_CATEGORIES.items() for x in kv])
    published = tx.parse_date(r["published"])
    return _paper(
        "arxiv",
        title=r["title"], url=r["id"], abstract=r["summary"], authors=_texts(_names(r["author"])),
        doi=r["arxiv:doi"], arxiv_id=arxiv_id(r["id"]), journal=r["arxiv:journal_ref"],
        published_date=published, year=F.year(published),
        fields_of_study=_texts(F.transform(
            r["category"], lambda c: F.coalesce(F.try_element_at(names, c["_term"]), c["_term"]))),
    )


_PROJECT = {"rss": _rss, "atom": _atom, "scholar": _scholar, "pubmed": _pubmed, "arxiv": _arxiv}
CORRUPT = "_corrupt_record"


def parse(payloads: DataFrame, kind: str, column: str, keep: tuple[str, ...] = (), journal: str | None = None) -> DataFrame:
    """Papers from a column that holds one record per row; ``is_valid`` is false for broken records."""
    schema = SCHEMAS[kind].strip() + f", {CORRUPT} STRING"
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    if kind == "scholar":
        r = F.from_json(column, schema, options)
    else:
        text = F.regexp_replace(column, INLINE_MARKUP, "") if kind == "pubmed" else F.col(column)
        r = F.from_xml(text, schema, {**options, "rowTag": ROW_TAGS[kind]})
    rec = payloads.withColumn("_r", r)
    given = None if journal is None else F.col(journal)
    return rec.select(
        *keep, (F.col("_r").isNotNull() & F.col(f"_r.{CORRUPT}").isNull()).alias("is_valid"),
        *_PROJECT[kind](F.col("_r"), given),
    )


def read(spark: SparkSession, kind: str, path: str, journal: str | None = None, streaming: bool = False) -> DataFrame:
    """Papers from landed files, with the file they came from; set ``streaming`` to watch the folder."""
    reader = spark.readStream if streaming else spark.read
    if kind == "pubmed":
        # records are cut at their end tag, so that inline markup can go before the XML is read
        pieces = reader.format("text").option("lineSep", "</PubmedArticle>").load(path).select(F.col("_metadata.file_path").alias("file"), "value")
        start = F.regexp_extract("value", r"(?s)<PubmedArticle(?=[\s>]).*$", 0)
        rows = pieces.select("file", start.alias("record")).where("record <> ''").withColumn("record", F.concat("record", F.lit("</PubmedArticle>")))
        return parse(rows, kind, "record", keep=("file",))
    schema = SCHEMAS[kind].strip() + f", {CORRUPT} STRING"
    if kind == "scholar":
        raw = reader.format("json").schema(schema).option("columnNameOfCorruptRecord", CORRUPT).load(path)
    else:
        raw = (
            reader.format("xml").schema(schema).option("rowTag", ROW_TAGS[kind])
            .option("columnNameOfCorruptRecord", CORRUPT).load(path)
        )
    rec = raw.select(
        F.col("_metadata.file_path").alias("file"), F.col(CORRUPT).alias("_bad"),
        F.struct(*[F.col(f"`{c}`") for c in raw.columns if c != CORRUPT]).alias("_r"),
    )
    given = None if journal is None else F.lit(journal)
    return rec.select("file", F.col("_bad").isNull().alias("is_valid"), *_PROJECT[kind](F.col("_r"), given))
