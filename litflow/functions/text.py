"""Text expressions: tokens, bigrams, titles, HTML, DOIs, dates, summaries. All are native Columns."""

from __future__ import annotations


from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters stripped from token ends.
TOKEN_EDGE = ".,;:!?()[]{}\"'"
# Characters stripped from title ends.
TITLE_EDGE = ".,;:!?\"'"
WHITE = " \t\n\r\x0b\f"

# Stop words of the keyword timeline.
TIMELINE_STOP = tuple(
    """the a an and or but in on at to for of with by from as is was are were been be have has had
    do does did will would this that these those it its we our their using based new novel propose
    proposed paper study method approach results show data model""".split()
)
# Stop words of the related-keyword count.
RELATED_STOP = tuple(
    """the a an and or but in on at to for of with by from as is was are were been using based new
    novel propose proposed""".split()
)
# Stop words of the cluster keywords.
CLUSTER_STOP = tuple(
    """the a an and or but in on at to for of with by from as is was are were been be have has had
    do does did will would could should may might must this that these those it its we our their
    they them paper study research method results approach using based propose proposed show
    demonstrate present novel""".split()
)
# Stop words of the topic model.
TOPIC_STOP = tuple(
    """the a an and or but in on at to for of with by from as is was are were been be have has had
    do does did will would this that these those it its we our their""".split()
)
# The TF-IDF stop list is this project's own: plain English function words.
TFIDF_STOP = tuple(
    """a about above after again against all also am an and any are as at be because been before
    being below between both but by can cannot could did do does doing down during each either else
    ever every few for from further had has have having he her here hers herself him himself his how
    i if in into is it its itself just less many may me might more most much must my myself neither
    no nor not now of off often on once only or other our ours ourselves out over own per perhaps
    rather same she should since so some still such than that the their theirs them themselves then
    there therefore these they this those though through thus to too toward under until up upon us
    very was we well were what when where whether which while who whom whose why will with within
    without would yet you your yours yourself yourselves""".split()
)


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITE))


def blank_to_null(c: Column) -> Column:
    return F.when(c != "", c)


def joined_text(title: Column, abstract: Column) -> Column:
    """Lower-cased "title abstract", the search text of every keyword operator."""
    return F.lower(F.concat_ws(" ", title, abstract))


def words(text: Column) -> Column:
    """Whitespace-separated words with punctuation stripped from both ends."""
    return F.transform(F.split(text, r"(?U)\s+"), lambda w: F.btrim(w, F.lit(TOKEN_EDGE)))


def is_keyword(w: Column, stop: tuple[str, ...], min_len: int) -> Column:
    """Alphabetic, longer than ``min_len`` and no stop word."""
    return (F.length(w) > min_len) & w.rlike(r"^\p{L}+$") & ~w.isin(*stop)


def tokens(text: Column, stop: tuple[str, ...], min_len: int) -> Column:
    return F.filter(words(text), lambda w: is_keyword(w, stop, min_len))


def bigrams(toks: Column) -> Column:
    """Pairs of adjacent tokens, joined by a blank."""
    n = F.size(toks)
    left = F.slice(toks, 1, F.greatest(n - 1, F.lit(0)))
    right = F.slice(toks, 2, F.greatest(n - 1, F.lit(0)))
    return F.zip_with(left, right, lambda a, b: F.concat(a, F.lit(" "), b))


def normalized_title(title: Column) -> Column:
    core = F.btrim(strip(F.lower(title)), F.lit(TITLE_EDGE))
    return strip(F.regexp_replace(core, r"(?U)\s+", " "))


def last_name(author: Column) -> Column:
    """Last whitespace-separated part of a lower-cased name; NULL for blank names."""
    return blank_to_null(F.element_at(F.split(strip(F.lower(author)), r"\s+"), -1))


def contains_phrase(text: Column, phrase: str) -> Column:
    """Whole-word search for a fixed phrase. The cheap byte search runs before the regex."""
    p = phrase.lower()
    pattern = r"(?U)\b\Q" + p.replace(r"\E", r"\E\\E\Q") + r"\E\b"
    return text.contains(p) & text.rlike(pattern)


def strip_html(c: Column) -> Column:
    return strip(F.regexp_replace(c, r"<[^>]+>", ""))


def usable_abstract(*candidates: Column) -> Column:
    """First candidate that has more than 50 characters once tags are removed."""
    cleaned = [strip_html(c) for c in candidates]
    return F.coalesce(*[F.when(F.length(c) > 50, c) for c in cleaned])


DOI_PATTERN = r"10\.\d{4,}/[^\s]+"


def doi_in(c: Column) -> Column:
    return blank_to_null(F.regexp_extract(c, DOI_PATTERN, 0))


def extract_doi(candidates: list[Column], links: Column) -> Column:
    """DOI from identifier fields, else from the first doi.org link that holds one."""
    direct = [F.when(c.startswith("10."), c).otherwise(doi_in(c)) for c in candidates]
    in_links = F.filter(
        F.transform(F.filter(links, lambda h: h.contains("doi.org")), doi_in),
        lambda d: d.isNotNull(),
    )
    return F.coalesce(*direct, F.get(in_links, F.lit(0)))


def preferred_url(link: Column, links: Column) -> Column:
    """The first doi.org link, else the entry's own link."""
    return F.coalesce(F.get(F.filter(links, lambda h: h.contains("doi.org")), F.lit(0)), link)


def first_nonempty_authors(*candidates: Column) -> Column:
    """First author array that is present; blank names are dropped."""
    present = [
        F.when(F.size(c) > 0, F.filter(c, lambda a: a.isNotNull() & (a != ""))) for c in candidates
    ]
    return F.coalesce(*present, F.array().cast("array<string>"))


# Date layouts accepted by the sources.
DATE_FORMATS = (
    "yyyy-MM-dd'T'HH:mm:ssXXX",
    "yyyy-MM-dd'T'HH:mm:ss",
    "EEE, d MMM yyyy HH:mm:ss Z",
    "EEE, d MMM yyyy HH:mm:ss z",
    "EEE, d MMM yyyy HH:mm Z",
    "EEE, d MMM yyyy HH:mm z",
    "EEE, d MMM yyyy HH:mm:ss",
    "EEE, d MMM yyyy HH:mm",
    "d MMM yyyy",
    "d MMMM yyyy",
    "MMM d, yyyy",
    "MMMM d, yyyy",
    "MMM yyyy",
    "MMMM yyyy",
    "yyyy-MM-dd",
    "yyyy-MM",
    "yyyy/MM/dd",
    "yyyy",
)


def parse_date(c: Column) -> Column:
    """First layout that fits, as a UTC timestamp; NULL when none does.

    Layouts that begin with a year also go through the SQL cast: T or a space, fractions, any zone.
    """
    s = strip(c)
    # a leading weekday is dropped because newer parsers reject it as a pattern letter
    s = F.regexp_replace(s, r"(?i)^(?:mon|tue|wed|thu|fri|sat|sun)[a-z]*,? ", "")
    formats = [f.replace("EEE, ", "") for f in DATE_FORMATS]
    by_cast = F.when(s.rlike(r"^\d{4}-\d"), s.try_cast("timestamp"))
    return F.coalesce(by_cast, *[F.try_to_timestamp(s, F.lit(f)) for f in formats])


def parse_trend_date(c: Column, as_of: Column) -> tuple[Column, Column]:
    """(date, was_defaulted): the first ten characters are parsed, else as_of - 30 days."""
    head = F.substring(c, 1, 10)
    parsed = F.coalesce(
        *[F.try_to_timestamp(head, F.lit(f)) for f in ("yyyy-MM-dd", "yyyy-MM", "yyyy", "yyyy/MM/dd")]
    )
    return F.coalesce(parsed, as_of - F.expr("INTERVAL 30 DAYS")), parsed.isNull()


# The sentences of the templates below.
def extractive_summary(title: Column, abstract: Column) -> Column:
    """First sentences (three at most) while their total stays below 400 characters."""
    sentences = F.slice(F.split(strip(abstract), r"(?<=[.!?])(?U)\s+"), 1, 3)
    start = F.struct(
        F.lit("").alias("text"), F.lit(0).alias("used"), F.lit(0).alias("kept"), F.lit(True).alias("open")
    )

    def step(acc: Column, s: Column) -> Column:
        fits = acc["open"] & (acc["used"] + F.length(s) < 400)
        grown = F.when(acc["kept"] == 0, s).otherwise(F.concat(acc["text"], F.lit(" "), s))
        return F.struct(
            F.when(fits, grown).otherwise(acc["text"]).alias("text"),
            (acc["used"] + F.when(fits, F.length(s)).otherwise(0)).alias("used"),
            (acc["kept"] + F.when(fits, 1).otherwise(0)).alias("kept"),
            fits.alias("open"),
        )

    folded = F.aggregate(sentences, start, step)
    fallback = F.concat(
        F.lit("This paper explores "),
        F.regexp_replace(F.lower(title), r"\.+$", ""),
        F.lit(". See abstract for details."),
    )
    return F.when(
        (F.length(abstract) > 100) & (folded["kept"] > 0), folded["text"]
    ).otherwise(fallback)


def relevance_note(name: str, keywords: tuple[str, ...], abstract: Column, score: Column) -> Column:
    """Template text that says why a paper is shown for an interest."""
    low = F.lower(abstract)
    found = F.filter(
        F.array(*[F.when(low.contains(k.lower()), F.lit(k)) for k in keywords])
        if keywords
        else F.array().cast("array<string>"),
        lambda k: k.isNotNull(),
    )
    return (
        F.when(
            F.size(found) > 0,
            F.concat(
                F.lit(f"Relevant to {name}: discusses "), F.array_join(F.slice(found, 1, 3), ", "), F.lit(".")
            ),
        )
        .when(score >= 0.5, F.lit(f"Connects to your interest in {name}."))
        .otherwise(F.lit(f"Some overlap with {name}."))
    )


def authors_display(authors: Column) -> Column:
    n = F.coalesce(F.size(authors), F.lit(0))
    return (
        F.when(n <= 0, F.lit("Unknown"))
        .when(n <= 3, F.array_join(authors, ", "))
        .otherwise(F.concat(F.get(authors, F.lit(0)), F.lit(" et al.")))
    )


def score_percent(score: Column) -> Column:
    return F.floor(score * 100).cast("int")


def keyword_label(keywords: Column) -> Column:
    """"A & B" from the first two keywords."""
    return F.initcap(F.array_join(F.slice(keywords, 1, 2), " & "))


def section_highlight(name: Column, n_papers: Column) -> Column:
    return F.concat(
        F.lit("This week brings "), n_papers.cast("string"), F.lit(" new papers relevant to "), name,
        F.lit(". Several papers show promising advances in key areas of interest."),
    )


def digest_intro(user_name: Column, digest_type: Column, total: Column, sections: Column) -> Column:
    first = F.coalesce(
        blank_to_null(F.get(F.split(strip(user_name), r"\s+"), F.lit(0))), F.lit("there")
    )
    return F.concat(
        F.lit("Hi "), first, F.lit("! Your "), digest_type, F.lit(" research digest is ready with "),
        total.cast("string"), F.lit(" papers across "), sections.cast("string"),
        F.lit(" research interest"), F.when(sections > 1, F.lit("s")).otherwise(F.lit("")),
        F.lit(". Here are the highlights curated just for you."),
    )


def subject_line(digest_type: Column, n_papers: Column, n_sections: Column) -> Column:
    n = n_papers.cast("string")
    return (
        F.when(digest_type == "immediate", F.concat(F.lit("High-priority paper alert ("), n, F.lit(" papers)")))
        .when(digest_type == "daily", F.concat(F.lit("Daily: "), n, F.lit(" new papers")))
        .otherwise(
            F.concat(
                F.lit("Weekly Digest: "), n, F.lit(" papers across "),
                n_sections.cast("string"), F.lit(" interests"),
            )
        )
    )
