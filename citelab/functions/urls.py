"""URL and domain functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from citelab.functions import lists
from citelab.functions.text import strip

#: One expression for scheme, host, path and query; the fragment is left out.
PARTS = r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?"
#: What canonical URLs don't carry.
TRACKING_PREFIX = "utm_"
TRACKING_KEYS = "srsltid fbclid gclid gclsrc dclid msclkid mc_cid mc_eid igshid ref ref_src yclid _hsenc _hsmi spm".split()


def _part(c, k: int) -> Column:
    return F.regexp_extract(c, PARTS, k)


def domain_of(url) -> Column:
    """The authority of an absolute URL, or null."""
    return F.nullif(F.regexp_extract(url, r"^[^:/?#]+://([^/?#]*)", 1), F.lit(""))


def bare_domain(url) -> Column:
    return F.regexp_replace(domain_of(url), r"^www\.", "")


def _decode(c: Column) -> Column:
    return F.coalesce(F.try_url_decode(c), c)


def canonical(url) -> Column:
    """Lower-case scheme (https if there is none) and host; no fragment and no tracking parameters; no slash at the end of a path."""
    u = strip(url)
    path = _part(u, 3)
    path = F.when(path.isin("", "/"), path).otherwise(F.regexp_replace(path, "/+$", ""))
    fields = F.filter(F.split(_part(u, 4), "&"), lambda p: p != "")
    key = lambda p: _decode(F.substring_index(p, "=", 1))
    value = lambda p: _decode(F.when(F.instr(p, "=") > 0, F.substring(p, F.instr(p, "=") + 1, F.length(p))).otherwise(""))
    kept = F.filter(fields, lambda p: ~F.lower(key(p)).startswith(TRACKING_PREFIX) & ~F.lower(key(p)).isin(*TRACKING_KEYS))
    query = F.array_join(F.transform(kept, lambda p: F.concat(F.url_encode(key(p)), F.lit("="), F.url_encode(value(p)))), "&")
    scheme = F.when(_part(u, 1) == "", F.lit("https")).otherwise(F.lower(_part(u, 1)))
    host = F.lower(_part(u, 2))
    return F.when(url.isNull() | (url == ""), url).otherwise(F.concat(scheme, F.lit(":"), F.when(host != "", F.concat(F.lit("//"), host)).otherwise(""), path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise("")))


def hash16(c) -> Column:
    return F.substring(F.sha2(c, 256), 1, 16)


def query_key(text) -> Column:
    return F.concat(F.lit("gb_"), hash16(strip(text)))


def response_id(engine, query, run) -> Column:
    return F.concat(engine, F.lit("__"), query, F.lit("__r"), run.cast("string"))


def path_depth(url) -> Column:
    return F.size(F.filter(F.split(_part(url, 3), "/"), lambda p: p != "")).cast("long")


def is_homepage(url) -> Column:
    return path_depth(url) == 0


def looks_like_url(c) -> Column:
    s = strip(F.coalesce(c, F.lit("")))
    return s.rlike(r"(?i)^(https?://|www\.)|\.(com|org|net|edu|gov|io|me|co|biz|info|us|uk|ca)(/|$)") | (~F.contains(s, F.lit(" ")) & F.contains(s, F.lit("/")))


def suffix(domain) -> Column:
    """The public suffix: the longest of the known ones of two labels, else the last label."""
    d = F.lower(F.trim(domain))
    two = F.substring_index(d, ".", -2)
    one = F.substring_index(d, ".", -1)
    return F.when((F.size(F.split(d, r"\.")) > 2) & two.isin(*lists.TWO_LABEL_SUFFIXES), two).when(F.contains(d, F.lit(".")), one)


def registrable(domain) -> Column:
    """The suffix and one label more; what has no suffix stays as it is."""
    d = F.lower(F.trim(domain))
    n = F.size(F.split(suffix(d), r"\.")) + 1
    return F.when(suffix(d).isNull() | d.rlike(r"^[\d.:]+$"), d).otherwise(F.call_function("substring_index", d, F.lit("."), -n))


def within(domain, names) -> Column:
    """Whether the domain is one of the names or below one: its own parents are looked up, so a list of any length costs one probe each."""
    labels = F.split(domain, r"\.")
    n = F.size(labels)
    parents = F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(labels, i, n), "."))
    return F.exists(parents, lambda p: p.isin(*names))


def _any_contained(c, names) -> Column:
    return c.rlike("|".join(n.replace(".", r"\.") for n in names))


def domain_class(domain) -> Column:
    """The kind of site; the first layer that fits."""
    d = F.lower(F.trim(domain.cast("string")))
    s = F.coalesce(suffix(d), F.lit(""))
    academic = (s == "edu") | s.startswith("edu.") | s.startswith("ac.")
    public = s.isin("gov", "mil", "int") | s.rlike(r"^(gov|gob|gouv|go|gc|mil)\.") | d.rlike(r"\.(gov|mil|gc\.ca)$")
    return (
        F.when(_any_contained(d, lists.WIKIMEDIA), "wikipedia")
        .when(within(d, lists.REFERENCE_HOSTS), "reference")
        .when(academic | within(d, [*lists.ACADEMIC_SITES, *lists.ACADEMIC_HOSTS]), "academic")
        .when(public | within(d, lists.PUBLIC_SITES), "government")
        .when(within(d, lists.NEWS_SITES), "news_media")
        .when(within(d, lists.REFERENCE_SITES), "reference")
        .when(within(d, [*lists.COMMUNITY_SITES, *lists.COMMUNITY_HOSTS]), "ugc_forum")
        .otherwise("commercial")
    )


def academic_class(domain) -> Column:
    d = F.lower(domain)
    return (
        F.when(_any_contained(d, lists.PREPRINT_SERVERS), "preprint")
        .when(_any_contained(d, lists.RESEARCH_DATABASES), "database")
        .when(_any_contained(d, lists.JOURNAL_PUBLISHERS), "journal")
        .when(_any_contained(d, lists.UNIVERSITY_MARKS), "university")
        .otherwise("research")
    )


def community_class(domain) -> Column:
    d = F.lower(domain)
    p = registrable(d)
    return (
        F.when(F.contains(d, F.lit("stackexchange.com")) | p.isin(*lists.FORUMS), "forum")
        .when(p.isin(*lists.CODE_SITES), "code")
        .when(p.isin(*lists.VIDEO_SITES), "video")
        .when(p.isin(*lists.BLOG_SITES), "blogging")
        .when(p.isin(*lists.SOCIAL_SITES), "social")
        .otherwise("community")
    )


def authority_tier(domain) -> Column:
    d = F.regexp_replace(F.lower(F.trim(domain.cast("string"))), r"^www\.", "")
    public = d.rlike(r"\.(gov|mil|edu|int)$|\.gov\.|\.edu\.|\.ac\.|\.gouv\.|\.go\.jp|\.go\.kr|\.gob\.")
    out = F.when(within(d, lists.TIERS["Academic"]), "Academic").when(public | within(d, lists.TIERS["Gov / Edu"]), "Gov / Edu")
    for tier, names in lists.TIERS.items():
        if tier not in ("Academic", "Gov / Edu"):
            out = out.when(within(d, names), tier)
    return out.otherwise("Commercial / other")
