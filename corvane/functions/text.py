"""Text functions as column expressions; Python (Arrow) only for Unicode normal forms, and there only for texts that need it."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

ColumnOr = Column | str
#: Fixed value: white space as JavaScript and Unicode count it.
WHITE = r"[\s\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
DASHES = r"[\x{2010}-\x{2015}\x{2212}\x{FE58}\x{FE63}\x{FF0D}]"


def col(c: ColumnOr) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, use) -> Column:
    """use(value) with `value` worked out once; written out in a lambda it would be worked out for every element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _former(form: str):
    @F.pandas_udf(T.StringType())
    def apply(s: pd.Series) -> pd.Series:
        return s.str.normalize(form)

    return apply


def normal_form(c: ColumnOr, form: str = "NFKC") -> Column:
    """Unicode normal form. Texts of ASCII, Cyrillic and common punctuation without marks are in every composed form already and stay in the JVM."""
    c = col(c)
    done = r"^[\x00-\x7F\x{0400}-\x{0482}\x{048A}-\x{052F}\x{00AB}\x{00BB}\x{2010}\x{2012}-\x{2016}\x{2018}-\x{201F}]*$"
    if form in ("NFD", "NFKD"):
        done = r"^[\x00-\x7F]*$"
    return F.coalesce(_former(form)(F.when(~c.rlike(done), c)), c)


def norm(c: ColumnOr, nfkc: bool = True) -> Column:
    """Search form: NFKC, lower case, ё as е, every palochka look-alike letter as one (small) palochka. Null gives the empty string."""
    c = F.coalesce(col(c), F.lit(""))
    return F.lower(F.translate(F.lower(normal_form(c) if nfkc else c), "ёiіӏ", "еӀӀӀ"))


def norm_query(q: str) -> str:
    """`norm` of a query on the driver, outer white space gone and inner collapsed."""
    s = unicodedata.normalize("NFKC", (q or "").strip()).lower().translate(str.maketrans("ёiіӏ", "еӀӀӀ")).lower()
    return " ".join(s.split())


def tokens(c: ColumnOr, nfkc: bool = True) -> Column:
    """Words of the search form: runs of letters and digits."""
    return F.filter(F.split(norm(c, nfkc), r"[^\p{L}\p{N}]+"), lambda x: x != "")


def query_tokens(q: str) -> list[str]:
    """`tokens` of a query on the driver."""
    return "".join(ch if ch.isalpha() or ch.isnumeric() else " " for ch in norm_query(q)).split()


def words(c: ColumnOr) -> Column:
    """Words of the lower-cased text, combining marks of Cyrillic kept in them."""
    return F.regexp_extract_all(F.lower(F.coalesce(col(c), F.lit(""))), F.lit(r"([\p{L}\p{N}\x{0400}-\x{04FF}]+)"), 1)


def has_token(c: ColumnOr, form: ColumnOr, nfkc: bool = True) -> Column:
    """Whether `form` (one or more words in search form) occurs as whole words; false for an empty form."""
    line = F.concat(F.lit(" "), F.array_join(tokens(c, nfkc), " "), F.lit(" "))
    f = F.lit(form) if isinstance(form, str) else form
    return (f != "") & line.contains(F.concat(F.lit(" "), f, F.lit(" ")))


def field_tier(c: ColumnOr, phrase: str, wanted: list[str], nfkc: bool = True) -> Column:
    """0: the phrase occurs in the field; 1: all of two or more words do; -1: neither. An empty phrase matches nothing."""
    if not phrase:
        return F.lit(-1)
    line = F.regexp_replace(norm(c, nfkc), WHITE + "+", " ")
    out = F.when(line.contains(phrase), 0)
    if len(wanted) >= 2:
        out = out.when(F.size(F.array_except(F.array(*map(F.lit, wanted)), tokens(c, nfkc))) == 0, 1)
    return out.otherwise(-1)


def record_tier(fields: list[ColumnOr], phrase: str, wanted: list[str], nfkc: bool = True) -> Column:
    """The best (lowest) tier of several fields, -1 if none matches."""
    tiers = [field_tier(f, phrase, wanted, nfkc) for f in fields]
    return F.coalesce(F.least(*[F.when(t >= 0, t) for t in tiers], F.lit(None).cast("int")), F.lit(-1))


def lak_form(c: ColumnOr) -> Column:
    """Store form: composed, lower case, {і, i, 1} as capital palochka, one kind of dash, single blanks."""
    c = F.translate(F.lower(normal_form(c, "NFC")), "іi1", "ӀӀӀ")
    return F.trim(F.regexp_replace(F.regexp_replace(c, DASHES, "-"), WHITE + "+", " "))


def lak_variants(c: ColumnOr) -> Column:
    """Spellings under which a store form may be found: every palochka as the capital, the small one, I, i, l, 1 or |."""
    base = lak_form(c)
    hub = F.translate(base, "ӏ", "Ӏ")
    return F.array_distinct(F.array(base, hub, *[F.translate(hub, "Ӏ", x) for x in ("ӏ", "I", "i", "l", "1", "|", "І")]))


def form_key(c: ColumnOr) -> Column:
    """Key for comparing forms of different sources: search form with small palochka, letters and digits only."""
    return F.regexp_replace(norm(c), r"[^\p{L}\p{N}]", "")


def without_marks(c: ColumnOr) -> Column:
    """The text with all combining marks dropped; й becomes и and ё becomes е."""
    return normal_form(F.regexp_replace(normal_form(c, "NFD"), r"\p{M}", ""), "NFC")


def slug(c: ColumnOr) -> Column:
    """Lower-case ASCII and Cyrillic letters and digits, everything else one dash."""
    plain = F.regexp_replace(normal_form(F.coalesce(col(c), F.lit("")), "NFKD"), r"[\x{0300}-\x{036F}]", "")
    return F.regexp_replace(F.regexp_replace(F.lower(plain), r"[^a-z0-9\x{0400}-\x{04FF}]+", "-"), r"^-+|-+$", "")


def stable_id(prefix: str, *parts: ColumnOr) -> Column:
    """prefix_ and 32 hex digits of SHA-256 over the parts joined by NUL; a null part counts as empty."""
    joined = F.concat_ws("\0", *[F.coalesce(col(p).cast("string"), F.lit("")) for p in parts])
    return F.concat(F.lit(prefix + "_"), F.substring(F.sha2(joined, 256), 1, 32))


def rolling_hash(c: ColumnOr) -> Column:
    """h = 31 h + code modulo 2^32 over the characters (code points up to U+FFFF)."""
    return F.aggregate(F.filter(F.split(col(c), ""), lambda x: x != ""), F.lit(0).cast("long"), lambda h, ch: (h * 31 + F.ascii(ch)) % 4294967296)


def hash32(c: ColumnOr) -> Column:
    """The first four bytes of SHA-1 as a number."""
    return F.conv(F.substring(F.sha1(col(c)), 1, 8), 16, 10).cast("long")


def half_up(c: Column, digits: int) -> Column:
    """Rounding of doubles half up, as floor(x * 10^d + 0.5) / 10^d."""
    p = float(10**digits)
    return F.floor(c * p + 0.5) / F.lit(p)


def clamp01(c: ColumnOr) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(col(c).cast("double"), F.lit(0.0))))


def script_of(c: ColumnOr) -> Column:
    """arabic, cyrillic, latin, mixed or unknown, by counts of letters."""
    c = F.coalesce(col(c), F.lit(""))
    ar, cy, la = (F.regexp_count(c, F.lit(p)) for p in (r"[\x{0600}-\x{06FF}]", r"[\x{0400}-\x{04FF}]", "[A-Za-z]"))
    return F.when((ar > cy) & (ar > la), "arabic").when(cy > 2 * la, "cyrillic").when(la > 2 * cy, "latin").when((cy > 0) | (la > 0), "mixed").otherwise("unknown")


def clip(c: ColumnOr, n: int) -> Column:
    """The first n characters with an ellipsis where something was cut."""
    c = col(c)
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("…"))).otherwise(c)


def sentences(c: ColumnOr, most: int | None = None) -> Column:
    """Sentences with their closing marks, all of them or the first `most`; marks before the first letter are dropped."""
    found = F.regexp_extract_all(F.coalesce(col(c), F.lit("")), F.lit(r"([^.!?…]+[.!?…]+(?:[\"»)]+)?\s*|[^.!?…]+$)"), 1)
    out = F.filter(F.transform(found, lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))), lambda x: x != "")
    return F.slice(out, 1, most) if most else out


def is_heading(c: ColumnOr) -> Column:
    """At most 90 characters, not empty, no closing mark."""
    t = F.trim(F.coalesce(col(c), F.lit("")))
    return (t != "") & (F.length(t) <= 90) & ~t.rlike(r"[.!?…]\z")


def number_tokens(c: ColumnOr, most: int = 400) -> Column:
    """Runs of up to four digits, in order."""
    return F.slice(F.regexp_extract_all(F.coalesce(col(c), F.lit("")), F.lit(r"(\d{1,4})"), 1), 1, most)


def shingle_sketch(toks: Column, n: int = 5, size: int = 512) -> Column:
    """The `size` smallest 32-bit hashes of the runs of n words; empty for fewer than n words."""
    def hashes(k: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size(k) - (n - 1)), lambda i: hash32(F.array_join(F.slice(k, i, n), " ")))

    return let(toks, lambda k: F.when(F.size(k) >= n, F.slice(F.array_sort(F.array_distinct(hashes(k))), 1, size)).otherwise(F.array().cast("array<long>")))


def sketch_jaccard(a: ColumnOr, b: ColumnOr, size: int = 512) -> Column:
    """Of the `size` smallest hashes of the union, the share that both hold; 0 where either is empty."""
    a, b = col(a), col(b)
    low = F.slice(F.array_sort(F.array_union(a, b)), 1, size)
    both = F.size(F.array_intersect(low, F.array_intersect(a, b)))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), half_up(both / F.size(low), 4)).otherwise(0.0)


def set_jaccard(a: ColumnOr, b: ColumnOr) -> Column:
    """Shared by all distinct values, four digits; 0 where either is empty."""
    a, b = col(a), col(b)
    return F.when((F.size(a) > 0) & (F.size(b) > 0), half_up(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)), 4)).otherwise(0.0)


#: Punctuation marks of the profile.
MARKS = (".", ",", ";", ":", "!", "?", "—", "-", "«", "»", "\"", "(", ")")


def punctuation(c: ColumnOr) -> Column:
    """Share of each of the 13 marks among all of them, as an array in the order of MARKS."""
    c = F.coalesce(col(c), F.lit(""))
    n = [(F.length(c) - F.length(F.replace(c, F.lit(m)))).cast("double") for m in MARKS]
    total = sum(n[1:], n[0])
    return F.array(*[F.when(total > 0, x / total).otherwise(0.0) for x in n])


def cosine(a: ColumnOr, b: ColumnOr) -> Column:
    """Cosine of two arrays of doubles, 0 where either has no length."""
    a, b = col(a), col(b)
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    size = F.sqrt(dot(a, a) * dot(b, b))
    return F.when(size > 0, dot(a, b) / size).otherwise(0.0)
