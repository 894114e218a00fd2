"""Personal data replaced by keyed surrogates, with DataFrame functions only.

1. Detection: one combined pattern finds mentions; each gets a type and a normal form
   (marks removed for numbers, lower case else), so that mentions of one entity corefer
   whatever their punctuation or case.
2. Each distinct entity gets a surrogate of the same type, format, script and gender
   from a stream keyed by a secret, the type, the normal form and an attempt number:
   digits become digits, letters letters of their script; card numbers keep first digit
   and check digit, account numbers country and check digits, octets stay octets, and
   names come from name lists by script and gender, longer by syllables where a list
   has fewer names than the corpus has persons.
3. Collision checks: where two entities draw one surrogate, or a surrogate is itself
   an entity of the corpus, all but one draw again; from the third attempt on, each
   further one draws from a format longer by one sign, so a few rounds settle all.
4. Each mention is rewritten in its own format and put back between the gaps of the text.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch

#: Titles and given names by gender, surrogate names by script and gender: fixed values.
TITLES = {"m": ["Mr", "Herr", "Sr", "Don"], "f": ["Mrs", "Ms", "Miss", "Frau", "Mme", "Sra"]}
GIVEN = {
    "m": ["Alexander", "Andreas", "Antonio", "Carlos", "Charles", "Daniel", "David", "Fernando", "Hans", "James", "Jean", "John", "José", "Juan", "Karl", "Luis", "Manuel", "Michael", "Miguel", "Paul", "Peter", "Philippe", "Pierre", "Richard", "Robert", "Thomas", "William"],
    "f": ["Ana", "Anna", "Carmen", "Catherine", "Claire", "Claudia", "Elena", "Elizabeth", "Emily", "Emma", "Greta", "Helen", "Isabel", "Jennifer", "Julia", "Laura", "Linda", "Lucía", "Maria", "María", "Marie", "Mary", "Monika", "Patricia", "Sarah", "Sophie", "Susan"],
}
NAMES = {
    ("latin", "m"): ["arno", "bruno", "carlo", "dario", "diego", "enzo", "franco", "guido", "hugo", "ivo", "kuno", "livio", "marco", "mario", "nico", "otto", "pablo", "paolo", "pedro", "rocco", "theo", "udo", "veno", "zeno"],
    ("latin", "f"): ["alma", "berta", "clara", "dora", "edda", "flora", "gina", "hanna", "ida", "irma", "jana", "katja", "lena", "marta", "nora", "olga", "paula", "rosa", "selma", "tessa", "ulla", "vera", "wilma", "zita"],
    ("cyrillic", "m"): ["антон", "борис", "виктор", "глеб", "денис", "егор", "захар", "игорь", "кирилл", "матвей", "олег", "роман"],
    ("cyrillic", "f"): ["алла", "варвара", "галина", "дарья", "елена", "зоя", "ирина", "лидия", "марина", "нина", "ольга", "тамара"],
    ("greek", "m"): ["άρης", "γιάννης", "δημήτρης", "ηλίας", "θάνος", "κώστας", "λουκάς", "μάριος", "νίκος", "πέτρος", "σταύρος", "φώτης"],
    ("greek", "f"): ["άννα", "βάσω", "γεωργία", "δήμητρα", "ελένη", "ζωή", "ιωάννα", "κατερίνα", "μαρία", "νίκη", "σοφία", "χαρά"],
}
#: Letters of syllables by script: consonants and vowels.
SYLLABLES = {"latin": ("bdfgklmnprst", "aeiou"), "cyrillic": ("бвгдклмнпрст", "аеио"), "greek": ("βγδκλμνπρστ", "αεο")}
LOWER = "abcdefghijklmnopqrstuvwxyz"
#: Letters by script for the surrogates' letters beyond ASCII: fixed values.
LATIN = "áàâäãåéèêëíìîïóòôöõúùûüñçß"
CYRILLIC = "абвгдежзиклмнопрстуфхцчшэюя"
GREEK = "αβγδεζηθικλμνξοπρστυφχψω"

_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
_WORD, _APART = r"(?:\p{Lu}['’])?\p{Lu}\p{Ll}{1,30}(?:[\-'’]\p{Lu}\p{Ll}{1,30})?", r"[\p{L}\p{N}]"


def _any(words: dict[str, list[str]]) -> str:
    return "|".join(sorted((w for ws in words.values() for w in ws), key=lambda w: (-len(w), w)))


_SECRET = r"(?=[PpSsTtAa])(?i:pass(?:word|wd|phrase)|pwd|secret|token|(?:api|access|private)[_\-]?key)[\"']?\s{0,3}[=:]\s{0,3}[\"']?"
#: A secret goes on to white space or a quote (in quotes that close on its line: to the next one), whatever its length; short ones need a digit or sign. Fixed values.
_OPEN, _LAST = r"[^\s\"'<>]", r"[^\s\"'<>.,;:!?)\]}]"
_VALUE = rf"(?:(?<=[\"'])[^\"'\r\n]{{6,}}+(?=[\"'])|{_OPEN}{{7,}}{_LAST}|(?={_OPEN}{{0,6}}[0-9!@#$%^&*_=+/~\-]){_OPEN}{{5,6}}{_LAST})"
#: A key's body goes on to its END line, with at most 64 hyphens (its headers have some); without such a line it starts with 32 signs of one, and goes on as far as it may be one. Fixed value.
_BODY = r"(?:[^\-]*+(?:-(?!----)[^\-]*+){0,64}+(?=-----END)|\s*[A-Za-z0-9+/=]{32}[A-Za-z0-9+/=\s]*+)"
#: Patterns by type, in the order in which they are tried: what stands before, the mention, what stands behind. Fixed values.
PATTERNS = {
    "pem": ("", rf"-----BEGIN [A-Z ]{{0,40}}PRIVATE KEY-----{_BODY}", ""),
    "email": (r"(?<![\p{L}\p{N}._%+\-])", r"[\p{L}\p{N}._%+\-]{1,256}@[\p{L}\p{N}\-]{1,63}(?:\.[\p{L}\p{N}\-]{1,63})+", ""),
    "secret": ("", rf"{_SECRET}{_VALUE}", ""),
    "cloudkey": (f"(?<!{_APART})", "AKIA[0-9A-Z]{16}", f"(?!{_APART})"),
    "ip": (r"(?<![0-9.])", rf"(?:{_OCTET}\.){{3}}{_OCTET}", r"(?![0-9.]*[0-9])"),
    "ip6": (r"(?<![\p{L}\p{N}:.])", r"(?=[0-9A-Fa-f:]*[0-9])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6})", r"(?![\p{L}\p{N}:.]*[\p{L}\p{N}:])"),
    "phone": ("", r"(?:\+[0-9]{1,3}[ \-]?(?:\([0-9]{2,4}\)[ \-]?)?|\([0-9]{2,5}\)[ \-]?)[0-9]{2,4}(?:[ \-][0-9]{2,4}){1,4}", "(?![0-9])"),
    "iban": (f"(?<!{_APART})", r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?", f"(?!{_APART})"),
    "card": (r"(?<![0-9\-])", r"[0-9]{4}(?:[ \-]?[0-9]{4}){2}[ \-]?[0-9]{1,7}", r"(?![0-9\-])"),
    "ssn": (r"(?<![0-9\-])", r"[0-9]{3}-[0-9]{2}-[0-9]{4}", r"(?![0-9\-])"),
    "name": (f"(?<!{_APART})(?=[\\p{{Lu}}][\\p{{Ll}}]+\\.?\\s\\p{{Lu}})", rf"(?:(?:{_any(TITLES)})\.?\s{_WORD}(?:\s{_WORD})?|(?:{_any(GIVEN)})\s{_WORD})", f"(?!{_APART})"),
}
COMBINED = "|".join(f"(?:{a}{m}{b})" for a, m, b in PATTERNS.values())
#: Replacements of up to so many bytes are broadcast; beyond it they are shuffled.
BROADCAST_BYTES = 64 << 20
#: Attempts after which a type whose format can't grow gets surrogates with a mark behind.
ATTEMPTS = 30


def _kind(m: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, (_, p, _) in reversed(PATTERNS.items()):
        p = {"pem": r"-----BEGIN [\s\S]*", "secret": rf"{_SECRET}[\s\S]*"}.get(name, p)  # their patterns look beyond their ends
        out = F.when(m.rlike(rf"\A(?:{p})\z"), name).otherwise(out)
    return out


def _fixed(m: Column, kind: Column) -> Column:
    """The part of a mention that stays in front of its variable part: a key word, a title, a first line."""
    starts = {"secret": rf"\A({_SECRET})", "name": rf"\A((?:{_any(TITLES)})\.?\s)", "pem": r"\A(-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----)", "cloudkey": r"\A(AKIA)"}
    out = F.lit("")
    for k, p in starts.items():
        out = F.when(kind == k, F.regexp_extract(m, p, 1)).otherwise(out)
    return out


def _gender(m: Column, kind: Column) -> Column:
    first = F.regexp_extract(m, r"\A(\p{L}+)", 1)
    return F.when(kind != "name", "").when(first.isin(TITLES["f"] + GIVEN["f"]), "f").otherwise("m")


def _normal(value: Column, kind: Column) -> Column:
    return F.when(kind.isin("phone", "card", "ssn", "iban"), F.lower(F.regexp_replace(value, "[^0-9A-Za-z]", ""))).otherwise(F.lower(value))


def _pick(choices: Column, r: Column) -> Column:
    return F.get(choices, F.pmod(r, F.size(choices)))


def _letters(alphabet: str) -> Column:
    return F.array(*map(F.lit, alphabet))


def _mod97(c: Column) -> Column:
    """A number of digits and letters (a = 10) modulo 97."""
    value = lambda x: F.when(x.rlike("[a-z]"), F.ascii(x) - 87).otherwise(x.cast("int"))
    return F.aggregate(_chars(c), F.lit(0), lambda acc, x: F.pmod(F.when(x.rlike("[a-z]"), acc * 100).otherwise(acc * 10) + value(x), F.lit(97)))


def _chars(c: Column) -> Column:
    return F.filter(F.split(c, ""), lambda x: x != "")


def _script(c: Column) -> Column:
    return F.when(c.rlike(r"\p{IsCyrillic}"), "cyrillic").when(c.rlike(r"\p{IsGreek}"), "greek").otherwise("latin")


def _name(normal: Column, gender: Column, stream: Column, syllables: Column) -> Column:
    """Each word's surrogate: the first from the list of its gender behind ``syllables`` syllables, the others of syllables only."""
    words = F.regexp_extract_all(normal, F.lit(r"[^ \-'’\s]+|[ \-'’\s]"), F.lit(0))
    spelt = {k: F.array(*(F.lit(a + b) for a in c for b in v)) for k, (c, v) in SYLLABLES.items()}

    def syllable(script: str, first: Column, n: Column) -> Column:
        return F.array_join(F.transform(F.sequence(F.lit(1), n), lambda j: _pick(spelt[script], F.get(stream, first + j))), "")

    def word(w: Column, i: Column) -> Column:
        start, out = F.pmod(i, F.lit(4)) * 40, F.lit("")
        for script in SYLLABLES:
            lists = F.when(gender == "f", F.array(*map(F.lit, NAMES[script, "f"]))).otherwise(F.array(*map(F.lit, NAMES[script, "m"])))
            front = F.when(syllables > 0, syllable(script, start, F.greatest(syllables, F.lit(1)))).otherwise("")
            new = F.when(i == 0, F.concat(front, _pick(lists, F.get(stream, start)))).otherwise(syllable(script, start, syllables + 2))
            out = F.when(_script(w) == script, new).otherwise(out)
        return F.when(w.rlike(r"[ \-'’\s]"), w).otherwise(out)

    return F.array_join(F.transform(words, word), "")


def _drawn(entities: DataFrame, key: str) -> DataFrame:
    """``entities`` with a surrogate of ``normal`` by ``kind``, ``gender`` and ``attempt``."""
    seed = F.concat_ws("\x1f", F.lit(key), "kind", "gender", "normal", F.col("attempt").cast("string"))
    kind, normal, size = F.col("kind"), F.col("normal"), F.length("normal")
    parts = F.greatest(F.ceil((size + F.col("attempt")) / 16), F.when(kind == "name", 10).otherwise(1)).cast("int")
    digest = F.transform(F.sequence(F.lit(1), parts), lambda i: F.sha2(F.concat(seed, F.lit("\x1f"), i.cast("string")), 256))
    numbers = F.flatten(F.transform(digest, lambda h: F.transform(F.sequence(F.lit(0), F.lit(15)), lambda k: F.conv(h.substr(k * 4 + 1, F.lit(4)), 16, 10).cast("int"))))
    df = entities.withColumn("stream", numbers).withColumn("extra", F.greatest(F.lit(0), F.col("attempt") - 2))
    stream = F.col("stream")
    hexa = (kind == "ip6") | ((kind == "secret") & normal.rlike(r"\A[0-9a-f]+\z"))

    def swapped(c: Column, i: Column) -> Column:
        r = F.get(stream, i)
        return (
            F.when(c.rlike("[0-9]"), _pick(_letters("0123456789"), r))
            .when(c.rlike("[a-z]"), F.when(hexa, _pick(_letters("abcdef"), r)).otherwise(_pick(_letters(LOWER), r)))
            .when(c.rlike(r"\p{IsCyrillic}"), _pick(_letters(CYRILLIC), r))
            .when(c.rlike(r"\p{IsGreek}"), _pick(_letters(GREEK), r))
            .when(c.rlike(r"\p{L}"), _pick(_letters(LATIN), r))
            .otherwise(c)
        )

    df = df.withColumn("swap", F.array_join(F.transform(_chars(normal), swapped), "")).withColumn("first", normal.substr(1, 1))
    swap, more = F.col("swap"), lambda alphabet: F.array_join(F.transform(F.slice(stream, size + 1, F.col("extra")), lambda r: _pick(_letters(alphabet), r)), "")
    tail = F.regexp_extract(normal, r"(\.[^.@]+)\z", 1)
    local = F.regexp_extract(swap, r"\A([^@]*)", 1)
    email = F.concat(local, more(LOWER), swap.substr(F.length(local) + 1, size - F.length(local) - F.length(tail)), tail)
    ip = F.array_join(F.transform(F.split(normal, r"\."), lambda c, i: (F.pmod(F.get(stream, i), F.lit(254)) + 1).cast("string")), ".")
    phone = F.concat("first", swap.substr(F.lit(2), size), more("0123456789"))
    body = F.concat("first", swap.substr(F.lit(2), size - 2))
    doubled = F.transform(F.reverse(_chars(body)), lambda c, i: F.when(i % 2 == 0, F.when(c.cast("int") > 4, c.cast("int") * 2 - 9).otherwise(c.cast("int") * 2)).otherwise(c.cast("int")))
    card = F.concat(body, F.pmod(10 - F.pmod(F.aggregate(doubled, F.lit(0), lambda a, x: a + x), F.lit(10)), F.lit(10)).cast("string"))
    country = normal.substr(1, 2)
    account = swap.substr(F.lit(5), size)
    iban = F.concat(country, F.lpad((98 - _mod97(F.concat(account, country, F.lit("00")))).cast("string"), 2, "0"), account)
    name = _name(normal, F.col("gender"), stream, F.col("attempt"))
    surrogate = F.when(kind == "email", email).when(kind == "ip", ip).when(kind == "phone", phone).when(kind == "card", card).when(kind == "iban", iban).when(kind == "name", name).when(kind == "secret", F.concat(swap, more("0123456789"))).otherwise(swap)
    marked = F.when((F.col("attempt") > ATTEMPTS) & (kind != "name"), F.concat(surrogate, F.lit("-"), F.sha2(seed, 256).substr(1, 32))).otherwise(surrogate)
    return df.select("kind", "gender", "normal", "attempt", marked.alias("surrogate"))


def _surrogates(entities: DataFrame, key: str, scratch: Scratch) -> DataFrame:
    """Distinct surrogates that are no entities themselves; redraws until no collision is left."""
    known = entities.select("kind", F.col("normal").alias("surrogate")).distinct()
    start = F.lit(0)  # names begin with as many syllables as leave most draws without collision
    for gender, n in entities.where("kind = 'name'").groupBy("gender").count().collect():
        start = F.when((F.col("kind") == "name") & (F.col("gender") == gender), max(0, math.ceil(math.log(max(1, n / 3)) / math.log(30)))).otherwise(start)
    settled, now = None, entities.withColumn("attempt", start)
    while True:
        drawn = scratch.save(_drawn(now, key))
        taken = known if settled is None else known.unionByName(settled.select("kind", "surrogate"))
        first = drawn.groupBy("kind", "surrogate").agg(F.min(F.struct("normal", "gender")).alias("first")).select("kind", "surrogate", "first.*")
        free = scratch.save(first.join(taken.distinct(), ["kind", "surrogate"], "left_anti"))
        settled = free if settled is None else settled.unionByName(free)
        if free.facts["n"] == drawn.facts["n"]:
            return settled
        now = drawn.join(free.select("kind", "gender", "normal"), ["kind", "gender", "normal"], "left_anti").select("kind", "gender", "normal", (F.col("attempt") + 1).alias("attempt"))


def _rewritten() -> Column:
    """The mention with its surrogate in its own format: columns mention, fixed, value, kind, normal, surrogate."""
    value, sur, kind = F.col("value"), F.col("surrogate"), F.col("kind")
    chars, rest = _chars(value), lambda n: sur.substr(n + 1, F.length(sur))
    sign = lambda c: c.rlike("[0-9A-Za-z]")
    place = lambda i: F.length(F.regexp_replace(value.substr(F.lit(1), i), "[^0-9A-Za-z]", ""))
    cased = lambda c, new: F.when(c != F.lower(c), F.upper(new)).otherwise(new)
    marked = F.concat(F.array_join(F.transform(chars, lambda c, i: F.when(sign(c), cased(c, sur.substr(place(i) + 1, F.lit(1)))).otherwise(c)), ""), rest(F.length("normal")))
    plain = F.concat(F.array_join(F.transform(chars, lambda c, i: cased(c, sur.substr(i + 1, F.lit(1)))), ""), rest(F.length(value)))
    same = F.length(value) == F.length("normal")  # letters exist that change their length with their case
    inside = F.when(kind.isin("phone", "card", "ssn", "iban"), marked).when(kind == "name", F.regexp_replace(F.initcap(F.regexp_replace(sur, r"([\-'’])", "$1 ")), r"([\-'’]) ", "$1")).when((kind == "ip") | ~same, sur).otherwise(plain)
    return F.concat("fixed", inside)


def replace_pii(docs: DataFrame, key: str) -> DataFrame:
    """``docs(doc_id, text, ...)`` -> ``doc_id, n_mentions, text``, one row per input row: mentions replaced by surrogates.

    ``key`` is the secret; the same key and corpus give the same surrogates.

    Edge cases: null texts stay null, empty ones empty, both with 0 mentions. Null and
    repeated doc_ids stay as they are. Mentions in repeated rows get equal surrogates.
    A type with more entities than surrogates of its format goes on with longer ones.
    Extra columns are ignored. An empty table gives an empty one.
    """
    scratch = Scratch(docs.sparkSession, "pii")
    name = [F.xxhash64("text").alias("t1"), F.crc32(F.encode("text", "utf-8")).alias("t2")]
    held = docs.select("text").where(F.col("text").rlike(COMBINED)).select(*name, F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(COMBINED), F.lit(0)))).alias("mention")).distinct()
    held = held.withColumn("kind", _kind(F.col("mention"))).withColumn("fixed", _fixed(F.col("mention"), F.col("kind"))).withColumn("gender", _gender(F.col("mention"), F.col("kind")))
    held = held.withColumn("value", F.expr("substr(mention, length(fixed) + 1)"))
    held = scratch.save(held.withColumn("normal", _normal(F.col("value"), F.col("kind"))))
    chosen = _surrogates(held.select("kind", "gender", "normal").distinct(), key, scratch)
    pairs = held.join(chosen, ["kind", "gender", "normal"]).select("t1", "t2", "mention", _rewritten().alias("new"))
    size = F.octet_length("mention") + F.octet_length("new") + 40
    maps = pairs.groupBy("t1", "t2").agg(F.map_from_entries(F.collect_list(F.struct("mention", "new"))).alias("new"), F.sum(size).alias("size"))
    maps = scratch.save(maps, bytes=F.sum("size"))
    small = (maps.facts["bytes"] or 0) <= BROADCAST_BYTES
    maps = maps.drop("size")
    rows = docs.select("doc_id", "text", *name).join(F.broadcast(maps) if small else maps, ["t1", "t2"], "left")
    gaps, found = F.split("text", COMBINED, -1), F.regexp_extract_all("text", F.lit(COMBINED), F.lit(0))
    put = F.array_join(F.zip_with(gaps, found, lambda g, m: F.concat(g, F.coalesce(F.element_at(F.col("new"), m), m, F.lit("")))), "")
    return rows.select("doc_id", F.when(F.col("new").isNotNull(), F.size(found)).otherwise(0).alias("n_mentions"), F.when(F.col("new").isNotNull(), put).otherwise(F.col("text")).alias("text"))
