"""Surrogates for personal data, in DataFrame functions alone.

One pattern finds e-mail addresses, phone numbers, IP addresses, payment cards,
social security numbers, IBANs, hexadecimal secrets, access tokens of known
forms, and names that follow a title.  A name found so is then sought in the
whole text, title or not, as long as its words begin with a capital or are all
capitals.  Each entity becomes a surrogate of its kind: drawn from a keyed
digest of its normal form, with the same punctuation, letter case and script,
the same number of digits, valid octets, a valid check digit where the original
had one, the same top-level domain, the same prefix of a token, and a given name
of the gender that its titles in the corpus tell (most of them; if they are
even, or tell none, a neutral one).

The same entity gets the same surrogate in every document and every spelling
(case of an address, separators of a number, a surname with or without a given
name, a given name after any title).  Distinct entities keep distinct
surrogates: the distinct units of the corpus are checked against each other and
against the real values, and those that collide draw again until none does.
From the eighth draw on the space widens (octets of any length, more syllables,
more letters; at last more digits), so the draws come to an end however many
real values there are.

What detection leaves out: names that no title introduces anywhere in the
document, names in scripts without capitals, postal addresses, dates of birth.
Dotted quads behind "version" or "release" are left alone.

Scale: a cheap test tells which texts can hold anything; only those are searched
and later met by their replacements, the others stay where they are.  Digests
are computed once for each distinct entity of the corpus, on rows dealt by
number.  Everything stays in the JVM.

Edge cases: null texts stay null, with no entities; empty texts stay empty;
null ids, repeated rows and equal texts are replaced row by row alike; a table
without entities passes unchanged; extra columns pass through, those named like
an output column are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Workspace, renamed, without

_START, _STOP = r"(?<![\p{L}\p{N}])", r"(?![\p{L}\p{N}])"
MALE = r"Mr|MR|Mister|Herrn?|Señor|Monsieur|Господин|Κύριος"
FEMALE = r"Mrs|MRS|Ms|MS|Miss|Frau|Señorita|Señora|Madame|Mademoiselle|Mme|Mlle|Госпожа|Κυρία"
NEUTRAL = r"Dr|DR|Prof|Mx"
_NAME = r"\p{Lu}[\p{L}'’\-]{1,40}"
_TITLE = rf"(?:{FEMALE}|{MALE}|{NEUTRAL})\.? "
_H = "[0-9a-fA-F]{1,4}"

#: Kind and pattern, the first that matches wins. Each begins with the cheapest test of where it can start.
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}_.%+\-])[\p{L}\p{N}_.%+\-]++@(?:[\p{L}\p{N}\-]{1,63}\.){1,8}\p{L}{2,63}",
    "ssn": r"(?=[0-9]{3}-)(?<![\p{L}\p{N}\-])\d{3}-\d{2}-\d{4}(?![\p{N}\-])",
    "card": r"(?=[0-9]{4})" + _START + r"(?:\d{4}[ \-]\d{4}[ \-]\d{4}[ \-]\d{4}|\d{13,19})" + _STOP,
    "phone": r"(?=[0-9+(])(?<![\p{L}\p{N}+])(?:\+\d{1,3}[ .\-]?\(?\d{2,4}\)?[ .\-]?\d{3,4}[ .\-]?\d{3,4}|\(\d{3}\) ?\d{3}[ .\-]\d{4}|\d{3}[.\-]\d{3}[.\-]\d{4})(?!\d)",
    "ip": r"(?=[0-9]{1,3}\.)(?<![\p{L}\p{N}.])(?<![Vv]ersion )(?<![Rr]elease )(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?!\d|\.\d|\p{L})",
    "ipv6": rf"(?=[0-9a-fA-F]{{1,4}}:)(?<![\p{{L}}\p{{N}}:])(?:(?:{_H}:){{7}}{_H}|(?:{_H}:){{1,6}}(?::{_H}){{1,6}})(?![\p{{L}}\p{{N}}:])",
    "iban": r"(?=[A-Z]{2}[0-9])" + _START + r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?" + _STOP,
    "secret": r"(?=[0-9a-fA-F]{32})" + _START + r"[0-9a-fA-F]{32,128}" + _STOP,
    "token": r"(?=[Agsx][KShkox])" + _START + r"(?:(?:AKIA|ASIA)[0-9A-Z]{16}|gh[opsur]_[0-9A-Za-z]{36,251}|sk[\-_][0-9A-Za-z_\-]{20,200}|xox[abprs]-[0-9A-Za-z\-]{10,200})" + _STOP,
    "person": rf"(?=[DFHMPSГΚ]){_START}{_TITLE}{_NAME}(?: {_NAME}){{0,2}}",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: What a text with any entity has.
_MAYBE = rf"[0-9@]|(?=[DFHMPSГΚ])(?:{FEMALE}|{MALE}|{NEUTRAL})\.? \p{{Lu}}|sk[\-_]|gh[opsur]_|xox[abprs]-|A[KS]IA"
_NAMES = ("surname", "given")
#: Draws after which the space of a kind widens, and after which even numbers get longer.
WIDEN, LENGTHEN = 8, 64

RESULT = ["n_entities", "kinds"]


def kind_of(e: Column) -> Column:
    out = F.lit("person")
    for kind in reversed([k for k in PATTERNS if k != "person"]):
        pattern = PATTERNS[kind].replace("(?<![Vv]ersion )(?<![Rr]elease )", "")
        out = F.when(e.rlike(f"^(?:{pattern})$"), F.lit(kind)).otherwise(out)
    return out


def _title(e: Column) -> Column:
    return F.regexp_extract(e, f"^{_TITLE}", 0)


def units_of(e: Column, kind: Column) -> Column:
    """An entity's parts, each (kind, raw, norm, gender), whose surrogates joined by spaces are the entity's."""
    plain = F.when(kind.isin("email", "secret", "ipv6"), F.lower(e)).otherwise(F.regexp_replace(e, r"[^\p{L}\p{N}]", ""))
    plain = F.when(kind.isin("ip", "token"), e).otherwise(plain)
    gender = F.when(e.rlike(rf"^(?:{FEMALE})\b"), "f").when(e.rlike(rf"^(?:{MALE})\b"), "m").otherwise("n")
    words = F.split(F.regexp_replace(e, f"^{_TITLE}", ""), " ")
    names = F.transform(words, lambda w, i: F.struct(F.when(i == F.size(words) - 1, F.lit("surname")).otherwise(F.lit("given")).alias("kind"), w.alias("raw"), F.lower(w).alias("norm"), gender.alias("gender")))
    return F.when(kind == "person", names).otherwise(F.array(F.struct(kind.alias("kind"), e.alias("raw"), plain.alias("norm"), F.lit("n").alias("gender"))))


def _byte(digest: Column, i: Column) -> Column:
    """The i-th of 128 digest bytes, from 0."""
    return F.conv(F.substring(digest, (F.pmod(i, F.lit(128)) * 2 + 1).cast("int"), F.lit(2)), 16, 10).cast("int")


def _letters(s: Column, digest: Column, keep: Column, span: Column) -> Column:
    """s with each letter and digit after the first ``keep`` of them drawn anew, in its own case and script."""

    def draw(i: Column) -> Column:
        c = F.substring(s, i, F.lit(1))
        nth = F.length(F.regexp_replace(F.substring(s, F.lit(1), i), r"[^\p{L}\p{N}]", ""))
        v = _byte(digest, nth)
        new = F.when(c.rlike(r"^\p{Nd}$"), (v % 10).cast("string"))
        for script, first, size in ((r"\p{IsCyrillic}", 0x430, 32), (r"\p{IsGreek}", 0x3B1, 17)):
            letter = F.substring(F.lit("".join(chr(first + k) for k in range(size))), v % size + 1, F.lit(1))
            new = new.when(c.rlike(f"^{script}$"), F.when(c.rlike(r"^\p{Lu}$"), F.upper(letter)).otherwise(letter))
        latin = F.char(F.lit(97) + v % span)
        new = new.when(c.rlike(r"^\p{L}$"), F.when(c.rlike(r"^\p{Lu}$"), F.upper(latin)).otherwise(latin)).otherwise(c)
        return F.when(nth <= keep, c).otherwise(new)

    return F.when(F.length(s) > 0, F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(F.length(s), F.lit(1))), draw), "")).otherwise(s)


def _luhn(digits: Column) -> Column:
    """The Luhn sum of a string of digits, modulo 10."""
    n = F.length(digits)

    def step(total: Column, i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return total + F.when((n - i) % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.lit(0), step) % 10


#: Syllables of drawn names and the ends that tell a gender, by script.
SYLLABLES = {
    "latin": ["ba", "be", "co", "da", "del", "fa", "gor", "ha", "jo", "ka", "lin", "lo", "mar", "mi", "na", "nor", "pe", "ra", "ri", "sa", "sol", "ta", "ti", "van", "ve", "wil", "yo", "zan", "el", "or", "um", "tre"],
    "cyrillic": ["ба", "во", "га", "де", "жо", "за", "ка", "ли", "ма", "ни", "по", "ра", "се", "та", "фо", "ши"],
    "greek": ["βα", "γο", "δε", "ζα", "θε", "κα", "λι", "μα", "νι", "πο", "ρα", "σε", "τα", "φο", "χι", "ψα"],
}
ENDS = {
    "latin": {"given_f": ["a", "ina", "elle", "ia"], "given_m": ["o", "us", "ert", "an"], "given_n": ["i", "is", "el", "en"], "surname": ["son", "ez", "mann", "ier"]},
    "cyrillic": {"given_f": ["а", "ина"], "given_m": ["ен", "ор"], "given_n": ["и", "е"], "surname": ["ко", "енко"]},
    "greek": {"given_f": ["α", "ινα"], "given_m": ["ος", "ης"], "given_n": ["ι", "ε"], "surname": ["ου", "ιδη"]},
}


def _name(kind: Column, raw: Column, digest: Column, attempt: Column) -> Column:
    def of(script: str) -> Column:
        parts = F.array(*[F.lit(s) for s in SYLLABLES[script]])
        pick = lambda i: F.element_at(parts, _byte(digest, F.lit(i)) % len(SYLLABLES[script]) + 1)
        more = F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.floor(attempt / WIDEN).cast("int"))), lambda i: F.element_at(parts, _byte(digest, i + 9) % len(SYLLABLES[script]) + 1)), "")
        end = None
        for k, ends in ENDS[script].items():
            this = F.element_at(F.array(*[F.lit(s) for s in ends]), _byte(digest, F.lit(9)) % len(ends) + 1)
            end = F.when(kind == k, this) if end is None else end.when(kind == k, this)
        return F.initcap(F.concat(pick(1), pick(2), pick(3), pick(4), F.when(attempt >= WIDEN, more).otherwise(""), end))

    name = F.when(raw.rlike(r"\p{IsCyrillic}"), of("cyrillic")).when(raw.rlike(r"\p{IsGreek}"), of("greek")).otherwise(of("latin"))
    shouted = (F.length(raw) > 1) & (raw == F.upper(raw)) & (raw != F.lower(raw))
    return F.when(shouted, F.upper(name)).otherwise(name)


def surrogate(kind: Column, raw: Column, norm: Column, gender: Column, attempt: Column, key: str) -> Column:
    """The surrogate of one unit in its own spelling."""
    seed = F.concat_ws("|", F.lit(key), kind, norm, attempt.cast("string"))
    digest = F.concat(F.sha2(F.concat(seed, F.lit("|a")), 512), F.sha2(F.concat(seed, F.lit("|b")), 512))
    span = F.when(kind.isin("secret", "ipv6"), 6).otherwise(26)
    prefix = F.length(F.regexp_replace(F.regexp_extract(raw, r"^(?:A[KS]IA|gh[opsur]_|sk[\-_]|xox[abprs]-)", 0), "[^A-Za-z]", ""))
    keep = F.when(kind == "phone", F.greatest(F.length(norm) - 10, F.lit(0))).when(kind == "card", 1).when(kind == "iban", 2).when(kind == "token", prefix).otherwise(0)
    drawn = _letters(raw, digest, keep, span)
    longer = F.concat(drawn, F.when(attempt >= LENGTHEN, F.conv(F.substring(digest, 250, 6), 16, 10)).otherwise(""))
    last = F.regexp_extract(raw, r"\.[^.]*$", 0)
    user = F.regexp_extract(raw, "^[^@]*", 0)
    host = F.substring(raw, F.length(user) + 1, F.length(raw) - F.length(user) - F.length(last))
    extra = F.lower(F.translate(F.substring(digest, F.lit(240), F.least(F.lit(16), F.lit(4) + attempt)), "0123456789", "ghijklmnop"))
    email = F.concat(_letters(user, digest, F.lit(0), span), F.when(attempt >= WIDEN, F.when(raw == F.upper(raw), F.upper(extra)).otherwise(extra)).otherwise(""), _letters(host, F.reverse(digest), F.lit(0), span), last)
    any_octet = lambda i: _byte(digest, i) % 256
    same_octet = lambda o, i: F.when(F.length(o) == 1, _byte(digest, i) % 10).when(F.length(o) == 2, _byte(digest, i) % 90 + 10).otherwise(_byte(digest, i) % 156 + 100)
    ip = F.array_join(F.transform(F.split(raw, r"\."), lambda o, i: F.when(attempt >= WIDEN, any_octet(i)).otherwise(same_octet(o, i)).cast("string")), ".")
    digits = F.regexp_replace(drawn, r"\D", "")
    final = F.substring(digits, -1, 1).cast("int")
    checked = F.concat(F.substring(drawn, F.lit(1), F.length(drawn) - 1), F.pmod(final - _luhn(digits), F.lit(10)).cast("string"))
    card = F.when(_luhn(norm) == 0, checked).otherwise(longer)
    name = _name(F.when(kind == "given", F.concat(F.lit("given_"), gender)).otherwise(kind), raw, digest, attempt)
    return F.when(kind == "email", email).when(kind == "ip", ip).when(kind == "card", card).when(kind.isin(*_NAMES), name).otherwise(longer)


def canonical(kind: Column, norm: Column, gender: Column, attempt: Column, key: str) -> Column:
    """The surrogate's normal form; it follows from the unit's normal form alone."""
    return F.lower(surrogate(kind, norm, norm, gender, attempt, key))


def _dealt(rows: DataFrame, *by: str, each: int = 20_000) -> DataFrame:
    """Rows in parts of equal number: they are short, but digests are slow."""
    return rows.repartition(max(8, -(-rows.count() // each)), *by)


def drawn_units(units: DataFrame, key: str, space: Workspace, draw=canonical) -> DataFrame:
    """units (kind, norm, gender) with the attempt that gives each a surrogate that no other unit of its kind has and that is no real value."""
    real = units.select(_class(F.col("kind")).alias("class"), F.lower("norm").alias("s"))
    todo, done, k = _dealt(units, "kind", "norm").withColumn("attempt", F.lit(0)), None, 0
    while True:
        tried = space.store(f"drawn{k}", todo.withColumn("s", draw(F.col("kind"), F.col("norm"), F.col("gender"), F.col("attempt"), key)).withColumn("class", _class(F.col("kind"))))
        fresh = tried.join(real, ["class", "s"], "left_anti")
        if done is not None:
            fresh = fresh.join(done.select("class", "s"), ["class", "s"], "left_anti")
        # Of those that draw the same at the same time, the first by name keeps it.
        won = space.store(f"won{k}", fresh.groupBy("class", "s").agg(F.min(F.struct("kind", "norm", "gender", "attempt")).alias("u")).select("u.*", "class", "s"))
        done = won if done is None else done.unionByName(won)
        todo = space.store(f"todo{k}", tried.join(won, ["kind", "norm"], "left_anti").select("kind", "norm", "gender", (F.col("attempt") + 1).alias("attempt")))
        if todo.isEmpty():
            return done.select("kind", "norm", "gender", "attempt")
        k += 1


def _class(kind: Column) -> Column:
    """Names share one space, given or not."""
    return F.when(kind.isin(*_NAMES), "name").otherwise(kind)


def with_surrogates(docs: DataFrame, *, key: str, text: str = "text", draw=canonical) -> DataFrame:
    """docs with text replaced, n_entities and kinds (a map from kind to how often it stands in the text).

    Who knows ``key`` can draw the surrogates of suspected values and compare; keep it secret.
    """
    docs = without(docs, RESULT)
    names = docs.columns
    docs, of = renamed(docs)
    text = of(text)
    space = Workspace(docs.sparkSession, "pii")
    body = F.col(text)
    maybe = F.coalesce(body.rlike(_MAYBE), F.lit(False))
    found = docs.where(maybe).select(F.md5(body).alias("mark"), F.explode(F.array_distinct(F.regexp_extract_all(body, F.lit(ANY), F.lit(0)))).alias("e"))
    held = space.store("held", found.distinct())
    entities = _dealt(held.select("e").distinct(), "e").withColumn("entity", kind_of(F.col("e")))
    parts = space.store("parts", entities.select("e", "entity", F.posexplode(units_of(F.col("e"), F.col("entity"))).alias("pos", "u")).select("e", "entity", "pos", "u.*"))
    # The gender that most titles tell, counted by texts.
    told = held.join(parts.where("kind = 'given' and gender != 'n'"), "e").groupBy("norm").agg((F.count_if(F.col("gender") == "f") - F.count_if(F.col("gender") == "m")).alias("lean"))
    known = parts.select("kind", "norm").distinct().join(told.withColumn("kind", F.lit("given")), ["kind", "norm"], "left")
    units = space.store("units", known.select("kind", "norm", F.when(F.col("lean") > 0, "f").when(F.col("lean") < 0, "m").otherwise("n").alias("gender")))
    chosen = space.store("chosen", drawn_units(units, key, space, draw))
    attempt = parts.drop("gender").join(chosen, ["kind", "norm"])
    spelled = _dealt(attempt, "e").withColumn("s", surrogate(F.col("kind"), F.col("raw"), F.col("norm"), F.col("gender"), F.col("attempt"), key))
    spelled = space.store("spelled", spelled.select("e", "entity", "pos", "kind", "raw", "s"))
    whole = spelled.groupBy("e", "entity").agg(F.array_sort(F.collect_list(F.struct("pos", "s"))).alias("l"))
    whole = whole.select("e", "entity", F.concat(F.when(F.col("entity") == "person", _title(F.col("e"))).otherwise(F.lit("")), F.array_join(F.col("l.s"), " ")).alias("s"))
    entries = held.join(whole, "e").select("mark", F.col("e").alias("token"), F.lit(0).alias("nth"), F.col("entity"), "s")
    words = held.join(spelled.where(F.col("kind").isin(*_NAMES)), "e")
    plain = words.select("mark", F.col("raw").alias("token"), F.when(F.col("kind") == "surname", 1).otherwise(2).alias("nth"), F.col("entity"), "s")
    loud = words.select("mark", F.upper("raw").alias("token"), F.lit(3).alias("nth"), F.col("entity"), F.upper("s").alias("s"))
    tokens = entries.unionByName(plain).unionByName(loud).groupBy("mark", "token").agg(F.min(F.struct("nth", "entity", "s")).alias("v"))
    mention = F.when(F.col("v.nth") > 0, F.struct((-F.length("token")).alias("less"), "token"))
    maps = tokens.groupBy("mark").agg(F.map_from_entries(F.collect_list(F.struct("token", F.struct("v.s", "v.entity")))).alias("_map"), F.array_join(F.array_sort(F.collect_list(mention))["token"], "|").alias("_words"))
    maps = space.store("maps", maps)
    space.keep("maps")
    rest = docs.where(~maybe).withColumn("n_entities", F.lit(0).cast("bigint")).withColumn("kinds", F.create_map().cast("map<string,int>"))
    return _replaced(docs.where(maybe), maps, text).unionByName(rest).toDF(*names, *RESULT)


def _replaced(docs: DataFrame, maps: DataFrame, text: str) -> DataFrame:
    body = F.col(f"`{text}`")
    docs = docs.withColumn("_mark", F.md5(body)).join(maps.withColumnRenamed("mark", "_mark"), "_mark", "left")
    pattern = F.concat(F.lit(ANY), F.when(F.col("_words") != "", F.concat(F.lit(f"|{_START}(?:"), F.col("_words"), F.lit(f"){_STOP}"))).otherwise(""))
    named = F.col("_words") != ""
    cut = lambda f: F.when(named, f(pattern)).otherwise(f(F.lit(ANY)))  # noqa: E731  a constant pattern is compiled once
    found = cut(lambda p: F.regexp_extract_all(body, p, F.lit(0)))
    between = cut(lambda p: F.split(body, p, -1))
    # An entity that only stands between mentions of names has no entry of its own; nothing of it is left to replace but what has one.
    known = F.transform(found, lambda x: F.struct(x.alias("e"), F.element_at(F.col("_map"), x).alias("v")))
    docs = docs.withColumn("_between", F.when(F.col("_map").isNotNull(), between)).withColumn("_known", F.when(F.col("_map").isNotNull(), known))
    spelled = F.transform(F.col("_known"), lambda x: F.coalesce(x["v"]["s"], x["e"]))
    whole = F.array_join(F.zip_with(F.col("_between"), F.concat(spelled, F.array(F.lit(""))), lambda a, b: F.concat(a, b)), "")
    kinds = F.filter(F.transform(F.col("_known"), lambda x: x["v"]["entity"]), lambda k: k.isNotNull())
    counted = F.map_from_arrays(F.array_distinct(kinds), F.transform(F.array_distinct(kinds), lambda k: F.size(F.filter(kinds, lambda x: x == k))))
    columns = [F.coalesce(whole, body).alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns if c not in ("_mark", "_map", "_words", "_between", "_known")]
    none = F.create_map().cast("map<string,int>")
    return docs.select(*columns, F.coalesce(F.size(kinds), F.lit(0)).cast("bigint").alias("n_entities"), F.coalesce(counted, none).alias("kinds"))
