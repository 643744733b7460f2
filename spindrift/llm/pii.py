"""PII: surrogates for personal data and secrets, keyed, of the same type and format, distinct and consistent.

One pattern finds the entities of a text; numbers of cards and accounts count only if their check digits are right. A name
is found by its title; in the same text, the full name and the surname are then found without it too. The same thing written in another way (case, separators, a name with or without
its title) is one identity, and an identity has one surrogate in the whole corpus, made from a keyed hash: digits become
digits, letters letters of their script and case, separators, country codes and top-level domains stay, card numbers
keep their check digit valid, addresses stay addresses, given names keep their gender. Distinct identities whose
surrogates meet, and surrogates that are themselves an identity of the corpus, are found by joins and made again with
another attempt, until none is left; so distinctness and coreference hold across documents.
"""

from __future__ import annotations

import secrets
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import fresh, stash

#: Rounds of new surrogates for identities whose surrogates meet, at most; more means that a type has no free ones left.
ROUNDS = 40
#: Characters of all surrogates that a broadcast takes at most; with more, the same join shuffles.
BROADCAST_CHARS = 16_000_000
#: Labels of a host after the first at most: a name has 253 characters. Without a bound the matcher's stack grows with them.
LABELS = 126
_WORD = r"[\p{L}\p{N}]"
#: Titles by the gender that they tell.
TITLES = {"m": ["Mr", "Herr", "Monsieur", "Señor"], "f": ["Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora"], "n": ["Dr", "Prof"]}
_TITLE = "|".join(t for ts in TITLES.values() for t in ts)
_NAME = r"(?:\p{Lu}\.|\p{Lu}[\p{L}\p{M}'-]++(?!\p{N})|\p{Lo}[\p{Lo}\p{M}]*+(?!\p{N}))"
_HEX = "[0-9A-Fa-f]{1,4}"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
#: Type and pattern of each kind of entity, in the order in which they are tried at a place.
PATTERNS = {
    "email": rf"(?<![\p{{L}}\p{{N}}._%+-]){_WORD}[\p{{L}}\p{{N}}._%+-]*+@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++){{0,{LABELS}}}(?<=\.[A-Za-z]{{2,24}})(?![A-Za-z0-9-])",
    "secret": r"(?<![\p{L}\p{N}])(?i:(?:token|secret|password|passwd|api[_-]?key)\"?\s{0,3}[=:]\s{0,3}\"?(?=[A-Za-z0-9_+/-]*\d)[A-Za-z0-9_+/-]{8,}+)|(?<![A-Za-z0-9])AKIA[0-9A-Z]{16}(?![A-Za-z0-9])",
    "ip": rf"(?<![\d.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\.?\d)",
    "ip6": rf"(?<![\p{{L}}\p{{N}}:.])(?:(?:{_HEX}:){{7}}{_HEX}|(?:{_HEX}:){{1,6}}(?::{_HEX}){{1,6}})(?![\p{{L}}\p{{N}}:.])",
    "iban": r"(?<![\p{L}\p{N}])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])",
    "phone": r"(?<![\d+])(?:\+\d{1,3}[ .-]?)?\(\d{3}\)[ .-]?\d{3}[ .-]?\d{4}(?!\d)|(?<![\d+])\+\d(?:[ .()-]{0,2}\d){7,14}(?!\d)|(?<![\d.-])\d{3}[ .-]\d{3}[ .-]\d{4}(?![\d-])",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "card": r"(?<![\d.-])\d(?:[ -]?\d){12,18}(?![\d])",
    "name": rf"(?<![\p{{L}}\p{{N}}])(?:{_TITLE})\.? {_NAME}(?: (?!(?:{_TITLE})\b){_NAME}){{0,3}}",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: Syllables of made-up names, by script: starts, middles, and ends for surnames and for given names by gender.
NAMES = {
    "latin": (["Bar", "Cal", "Dor", "El", "Fen", "Gar", "Hol", "Jor", "Kel", "Lor", "Mar", "Nor", "Or", "Pel", "Ros", "Tal"], ["a", "be", "di", "fa", "ge", "ke", "li", "mo", "na", "ro", "si", "ta", "vi", "wa", "ye", "zo"], {"s": ["ck", "ford", "ley", "man", "ner", "son", "th", "ton"], "m": ["bert", "don", "mund", "nard", "rick", "ron", "win", "vin"], "f": ["bella", "dra", "lina", "lyn", "mina", "nelle", "ria", "sia"], "n": ["bin", "dy", "kim", "len", "ly", "ren", "ri", "sky"]}),
    "greek": (["Βαρ", "Γαλ", "Δημ", "Ζαχ", "Θεο", "Καλ", "Λαμ", "Μαρ", "Νικ", "Παν", "Ραλ", "Σταμ", "Τριαν", "Φιλ", "Χαρ", "Ψαλ"], ["α", "βε", "γι", "δο", "ζα", "θε", "κι", "λο", "μα", "νε", "πι", "ρο", "σα", "τε", "φι", "χο"], {"s": ["ίδης", "άκης", "όπουλος", "ίου", "άτος", "ινός", "έλης", "ούδης"], "m": ["νος", "ρης", "σιος", "τας", "λης", "κος", "μος", "δης"], "f": ["νία", "ρία", "σία", "τα", "λη", "κα", "μη", "δα"], "n": ["ρι", "νη", "σε", "τε", "λυ", "κι", "μυ", "δυ"]}),
    "han": (list("王李张刘陈杨赵黄周吴徐孙胡朱高林"), list("安博成达恩芳国海家建俊康丽明宁平"), {"s": list("仁山松泰文贤雪阳"), "m": list("刚峰涛伟强军勇鹏"), "f": list("娟婷梅兰英霞燕娜"), "n": list("清瑞思晓怡雨泽志")}),
    "hangul": (list("김이박최정강조윤장임한오서신권황"), list("가나다라마바사아자차카타파하서수"), {"s": list("호진석민준영철환"), "m": list("훈혁식태욱규범재"), "f": list("희경숙미연은정주"), "n": list("빈솔유인지현윤설")}),
    "arabic": (["بار", "جمال", "حس", "خال", "دار", "رام", "زاه", "سام", "شاه", "صال", "طار", "عاد", "فار", "كام", "ماج", "نادر"], ["ا", "بو", "تي", "جا", "دي", "را", "سي", "عو", "فا", "قو", "كي", "لا", "مي", "نو", "وا", "يا"], {"s": ["اني", "اوي", "ري", "دين", "مان", "سي", "لي", "بي"], "m": ["د", "ر", "م", "ن", "ل", "س", "ف", "ق"], "f": ["ة", "اء", "ى", "ان", "ية", "رة", "مة", "نة"], "n": ["و", "ي", "ه", "ت", "ك", "ب", "ح", "ص"]}),
    "cyrillic": (["Бар", "Вал", "Гор", "Дар", "Зор", "Кал", "Лад", "Мир", "Нев", "Ор", "Пол", "Рад", "Свет", "Тал", "Фад", "Яр"], ["а", "бе", "ви", "го", "де", "же", "за", "ки", "ла", "ме", "но", "ра", "си", "ту", "фе", "ше"], {"s": ["вич", "енко", "ский", "ров", "тов", "чук", "шин", "нов"], "m": ["дан", "мил", "мир", "рис", "слав", "тин", "фей", "хар"], "f": ["дана", "лина", "мила", "ната", "рина", "сия", "фия", "ша"], "n": ["ден", "жен", "ки", "лен", "рен", "ри", "са", "шу"]}),
}


def kind_of(entity: Column) -> Column:
    """The type of what ANY or a text's names found; null for numbers whose check digits are wrong, which are no entities."""
    whole = [F.when(entity.rlike(rf"\A(?:{p})\z"), k) for k, p in PATTERNS.items() if k not in ("email", "secret")]
    kind = F.coalesce(F.when(F.contains(entity, F.lit("@")), "email"), F.when(entity.rlike(r"\A(?i:token|secret|pass|api|akia)[^\p{L}\p{N}]|\A(?i:token|secret|pass|api|akia).*\d"), "secret"), F.when(~entity.rlike(r"\d|:"), "name"), *whole, F.lit("card"))
    plain = F.regexp_replace(entity, r"[^\p{L}\p{N}]", "")
    wrong = ((kind == "card") & (luhn_sum(plain) % 10 != 0)) | ((kind == "iban") & (iban_rest(plain) != 1))
    return F.when(~F.coalesce(wrong, F.lit(False)), kind)


def _gender(title: Column) -> Column:
    return reduce(lambda out, g: out.when(title.isin(TITLES[g]), g), TITLES, F.when(F.lit(False), "n"))


def parts_of(kind: Column, entity: Column, known: Column) -> Column:
    """The identities in an entity: array<struct<type, norm>>. A name has one per word, others have one.

    known: what the text's titled names say of their words, as such an array.
    """
    plain = F.lower(F.regexp_replace(entity, r"[^\p{L}\p{N}]", ""))
    words = F.split(F.regexp_replace(entity, rf"\A(?:{_TITLE})\.? ", ""), " ")
    gender = _gender(F.regexp_extract(entity, rf"\A({_TITLE})", 1))
    said = lambda w: F.get(F.filter(known, lambda k: k["norm"] == F.lower(w)), F.lit(0))["type"]
    own = lambda i: F.when(i == F.size(words) - 1, "surname").otherwise(F.concat(F.lit("given_"), F.coalesce(gender, F.lit("n"))))
    names = F.transform(words, lambda w, i: F.struct(F.coalesce(said(w), own(i)).alias("type"), F.lower(w).alias("norm")))
    norm = F.when(kind.isin("ip", "email"), F.lower(entity)).when(kind == "secret", F.regexp_replace(entity, r"\A(?i:token|secret|passwd|password|api[_-]?key)\"?\s*[=:]\s*\"?", "")).when((kind == "phone") & (F.length(plain) == 10), F.concat(F.lit("1"), plain)).otherwise(plain)
    return F.when(kind == "name", names).otherwise(F.array(F.struct(kind.alias("type"), norm.alias("norm"))))


def _byte(digest: Column, i: Column | int) -> Column:
    """Byte i of a hexadecimal text of 256 digits; it begins again after 128 bytes."""
    return F.conv(F.substring(digest, F.pmod(F.lit(i) if isinstance(i, int) else i, F.lit(128)) * 2 + 1, F.lit(2)), 16, 10).cast("int")


def _pick(values: list[str], n: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), F.pmod(n, F.lit(len(values))) + 1)


def _character(c: Column, n: Column, latin: Column | int = 26) -> Column:
    """Another character of the same class: digit, letter of the script and case; of the first `latin` Latin letters."""
    shift = lambda first: F.char(F.lit(first) + F.pmod(n, F.lit(latin) if isinstance(latin, int) else latin))
    cyrillic = lambda letters: F.substring(F.lit(letters), F.pmod(n, F.lit(32)) + 1, F.lit(1))
    lower, upper = "абвгдежзийклмнопрстуфхцчшщъыьэюя", "АБВГДЕЖЗИЙКЛМНОПРСТУФХЦЧШЩЪЫЬЭЮЯ"
    return (
        F.when(c.rlike(r"\A[0-9]\z"), F.pmod(n, F.lit(10)).cast("string")).when(c.rlike(r"\A[А-ЯЁ]\z"), cyrillic(upper)).when(c.rlike(r"\A[а-яё]\z"), cyrillic(lower))
        .when(c.rlike(r"\A\p{Lu}\z"), shift(65)).when(c.rlike(r"\A\p{L}\z"), shift(97)).otherwise(c)
    )


def luhn_sum(digits: Column) -> Column:
    """The check sum of a text of digits."""
    each = F.transform(F.reverse(F.filter(F.split(digits, ""), lambda c: c != "")), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(F.pmod(c.cast("int") * 2, F.lit(10)) + (c.cast("int") * 2 >= 10).cast("int")))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x)


def iban_rest(text: Column) -> Column:
    """An account number (letters and digits) modulo 97, with its first four characters last and letters as 10 to 35."""
    turned = F.upper(F.concat(F.substring(text, F.lit(5), F.length(text)), F.substring(text, F.lit(1), F.lit(4))))
    value = lambda c: F.when(c.rlike(r"\A\d\z"), c.cast("int")).otherwise(F.ascii(c) - 55)
    return F.aggregate(F.filter(F.split(turned, ""), lambda c: c != ""), F.lit(0), lambda a, c: F.pmod(F.when(c.rlike(r"\A\d\z"), a * 10).otherwise(a * 100) + value(c), F.lit(97)))


def surrogate_of(kind: Column, norm: Column, attempt: Column, key: str) -> Column:
    """The surrogate of an identity, as long as the norm but for names and addresses."""
    seed = F.concat_ws("|", kind, norm, attempt.cast("string"))
    # Hashed with the key twice, so that no hash can be carried on by somebody without it.
    keyed = lambda text: F.sha2(F.concat(F.lit(f"outer|{key}|"), F.sha2(F.concat(F.lit(f"inner|{key}|"), text), 512)), 512)
    digest = F.concat(keyed(seed), keyed(F.concat(seed, F.lit("|more"))))
    latin = F.when((kind == "ip6") | (kind == "secret") & norm.rlike(r"\A(?:[0-9a-f]+|[0-9A-F]+)\z"), 6).otherwise(26)  # hexadecimal stays so
    chars = lambda text, kept: F.array_join(F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c, i: F.when(kept(i), c).otherwise(_character(c, _byte(digest, i), latin))), "")
    never = lambda i: F.lit(False)
    domain_end = F.length(norm) - F.length(F.substring_index(norm, ".", -1))
    card = chars(F.substring(norm, F.lit(1), F.length(norm) - 1), never)
    # The last digit makes the check sum right, as it was; so do an account's third and fourth character.
    last = F.pmod(10 - F.pmod(luhn_sum(F.concat(card, F.lit("0"))), F.lit(10)), F.lit(10))
    account = chars(norm, lambda i: i < 4)
    country, rest = F.substring(account, F.lit(1), F.lit(2)), F.substring(account, F.lit(5), F.length(account))
    account = F.concat(country, F.lpad((98 - iban_rest(F.concat(country, F.lit("00"), rest))).cast("string"), 2, "0"), rest)
    octets = F.concat_ws(".", (1 + F.pmod(_byte(digest, 0), F.lit(223))).cast("string"), *[_byte(digest, i).cast("string") for i in (1, 2, 3)])
    phone = chars(norm, lambda i: i < F.greatest(F.length(norm) - 10, F.lit(0)))
    secret = chars(norm, lambda i: norm.rlike(r"\AAKIA") & (i < 4))
    made = {}
    for script, (starts, middles, ends) in NAMES.items():
        end = reduce(lambda out, g: out.when(kind.endswith(g) if g != "s" else kind == "surname", _pick(ends[g], _byte(digest, 9))), ["s", "m", "f", "n"], F.when(F.lit(False), ""))
        # Each further attempt adds a syllable, so that there are always more names than identities.
        middle = F.array_join(F.transform(F.sequence(F.lit(0), attempt), lambda i: _pick(middles, _byte(digest, i + 10))), "")
        made[script] = F.lower(F.concat(_pick(starts, _byte(digest, 8)), middle, end))
    # An initial stays one letter; the other scripts' names are of syllables of the Latin one.
    name = reduce(lambda out, script: out.when(norm.rlike(rf"\p{{Is{script.capitalize()}}}"), made[script]), [x for x in made if x != "latin"], F.when(norm.rlike(r"\A\p{L}\.?\z"), chars(norm, never))).otherwise(made["latin"])
    return F.when(kind == "ip", octets).when(kind == "card", F.concat(card, last.cast("string"))).when(kind == "phone", phone).when(kind == "email", chars(norm, lambda i: i >= domain_end)).when(kind == "secret", secret).when(kind.isin("ssn", "ip6"), chars(norm, never)).when(kind == "iban", account).otherwise(name)


def written_like(entity: Column, kind: Column, made: Column) -> Column:
    """The surrogates `made` (one per identity) in the entity's own form."""
    first = made[0]
    own = F.length(F.regexp_replace(entity, r"[^\p{L}\p{N}]", ""))
    step = lambda a, c: F.when(c.rlike(r"\A[\p{L}\p{N}]\z"), F.struct(F.concat(a["out"], F.when(c.rlike(r"\A\p{Lu}\z"), F.upper(F.substring(first, a["k"], F.lit(1)))).otherwise(F.substring(first, a["k"], F.lit(1)))).alias("out"), (a["k"] + 1).alias("k"))).otherwise(F.struct(F.concat(a["out"], c).alias("out"), a["k"].alias("k")))
    refill = lambda text: F.aggregate(F.filter(F.split(text, ""), lambda c: c != ""), F.struct(F.lit("").alias("out"), (F.length(first) - own + 1).alias("k")), step, lambda a: a["out"])
    title = F.regexp_extract(entity, rf"\A(?:{_TITLE})\.? ", 0)
    words = F.split(F.regexp_replace(entity, rf"\A(?:{_TITLE})\.? ", ""), " ")
    named = F.transform(made, lambda s, i: F.when(F.length(words[i]) > 1, F.when(F.upper(words[i]) == words[i], F.upper(s)).otherwise(F.initcap(s))).otherwise(F.initcap(s)))
    # An email keeps its separators at their places in the surrogate; only the case of letters is the entity's.
    cased = F.array_join(F.transform(F.filter(F.split(first, ""), lambda c: c != ""), lambda c, i: F.when(F.substring(entity, i + 1, F.lit(1)).rlike(r"\A\p{Lu}\z"), F.upper(c)).otherwise(c)), "")
    secret = F.concat(F.substring(entity, F.lit(1), F.length(entity) - F.length(first)), first)
    return F.when(kind == "ip", first).when(kind == "email", cased).when(kind == "secret", secret).when(kind == "name", F.concat(title, F.array_join(named, " "))).otherwise(refill(entity))


def assign(identities: DataFrame, key: str) -> DataFrame:
    """type, norm and surrogate of distinct identities (type, norm); the surrogates of a type are distinct and none of its
    norms. One-letter initials alone may share a surrogate. More identities than a type has surrogates are an error."""
    initial = F.col("norm").rlike(r"\A\p{L}\.?\z")
    named = identities.withColumn("attempt", F.lit(0))
    make = lambda rows: rows.withColumn("surrogate", surrogate_of(F.col("type"), F.col("norm"), F.col("attempt"), key))
    found = stash(make(named))
    for _ in range(ROUNDS):
        # Whoever got a surrogate by an earlier attempt keeps it; then the order of hashes decides.
        rank = F.row_number().over(Window.partitionBy("type", "surrogate").orderBy("attempt", F.xxhash64("norm"), "norm"))
        taken = found.select("type", F.col("norm").alias("surrogate"), F.lit(True).alias("real"))
        judged = found.withColumn("rank", rank).join(taken, ["type", "surrogate"], "left").withColumn("again", ~initial & ((F.col("rank") > 1) | F.col("real").isNotNull()))
        judged = stash(judged.drop("rank", "real"))
        if not judged.filter("again").head(1):
            return found.select("type", "norm", "surrogate")
        again = make(judged.filter("again").select("type", "norm", (F.col("attempt") + 1).alias("attempt")))
        found = stash(judged.filter("not again").drop("again").unionByName(again))
    raise ValueError(f"after {ROUNDS} rounds some surrogates still meet: a type has hardly any free ones left")


def _own_pattern(found: Column, known: Column) -> Column:
    """For a text with titled names: ANY, or the full names and surnames without a title; null for other texts."""
    title = rf"\A(?:{_TITLE})\.? "
    full = F.transform(F.filter(found, lambda x: x.rlike(title)), lambda x: F.regexp_replace(x, title, ""))
    last = F.transform(full, lambda x: F.substring_index(x, " ", -1))
    # The longest first; a pattern takes the first that fits. Letters, points, dashes and apostrophes are all there is.
    listed = F.array_sort(F.filter(F.array_distinct(F.concat(full, last)), lambda x: F.length(x) > 1), lambda a, b: F.length(b) - F.length(a))
    either = F.regexp_replace(F.array_join(listed, "|"), r"\.", r"\\.")
    return F.when((F.size(known) > 0) & (F.size(listed) > 0), F.concat(F.lit(ANY + r"|(?<![\p{L}\p{N}])(?:"), either, F.lit(r")(?![\p{L}\p{N}])")))


def replace_pii(docs: DataFrame, key: str | None = None, text: str = "text", count: str | None = None) -> DataFrame:
    """`docs` with each entity of `text` replaced by its surrogate; all else of a text stays as it is, to the byte.

    key: makes the surrogates; the same one gives the same ones. Without it, one is drawn for this call. count: name of a
    column for the number of entities; it replaces one of that name. Null texts stay null; texts of any length count
    whole (an address ends with its 127th label); rows without entities are unchanged. Repeated rows, and any with a null doc_id, are treated by their text
    alone. Identities whose surrogates meet are told apart by the order of their hashes. An empty table gives an empty one.
    """
    key = key or secrets.token_hex(32)
    whole_text = F.col(f"`{text}`")
    p, q, new, own, number = fresh(docs, "p", "q", "new", "own", "number")
    # A text is named by two hashes, as ids may be null or repeat.
    known = docs.withColumns({p: F.xxhash64(whole_text, F.length(whole_text)), q: F.crc32(whole_text)})
    texts = known.select(F.col(p).alias("p"), F.col(q).alias("q"), whole_text.alias("t"), F.regexp_extract_all(whole_text, F.lit(ANY), F.lit(0)).alias("e")).filter("size(e) > 0")
    none = F.expr("cast(array() as array<struct<type:string,norm:string>>)")
    titled = F.filter("e", lambda x: x.rlike(rf"\A(?:{_TITLE})\.? "))
    texts = texts.withColumn("names", F.flatten(F.transform(titled, lambda x: parts_of(F.lit("name"), x, none)))).withColumn("own", _own_pattern(F.col("e"), F.col("names")))
    texts = texts.withColumn("e", F.when(F.col("own").isNotNull(), F.regexp_extract_all("t", F.col("own"), F.lit(0))).otherwise(F.col("e")))
    entities = stash(texts.select("p", "q", "own", "names", "e").dropDuplicates(["p", "q"]))
    each = entities.select("p", "q", "names", F.posexplode("e").alias("at", "entity")).withColumn("kind", kind_of(F.col("entity"))).filter("kind is not null")
    parts = stash(each.select("*", F.posexplode(parts_of(F.col("kind"), F.col("entity"), F.col("names"))).alias("part", "id")).select("p", "q", "at", "entity", "kind", "part", "id.type", "id.norm"))
    made = assign(parts.select("type", "norm").distinct(), key)
    # A third of all entities may be one identity: an equi-join of two exchanges, which adaptive execution splits.
    joined = parts.join(made, ["type", "norm"])
    written = joined.groupBy("p", "q", "at", "entity", "kind").agg(F.transform(F.array_sort(F.collect_list(F.struct("part", "surrogate"))), lambda x: x["surrogate"]).alias("made"))
    rows = written.select("p", "q", "at", written_like(F.col("entity"), F.col("kind"), F.col("made")).alias("new"))
    lists = rows.groupBy("p", "q").agg(F.map_from_entries(F.collect_list(F.struct("at", "new"))).alias("m")).join(entities, ["p", "q"])
    # What is no entity stays as it is at its place.
    lists = lists.select("p", "q", "own", F.transform("e", lambda x, i: F.coalesce(F.try_element_at("m", i), x)).alias("new"), F.size("m").alias("n"))
    # Stored, so that copies of one text, however many, are split in the join.
    lists = stash(lists.select(F.col("p").alias(p), F.col("q").alias(q), F.col("own").alias(own), F.col("new").alias(new), F.col("n").cast("long").alias(number)))
    size = lists.agg(F.coalesce(F.sum(F.length(F.concat_ws("", new)) + F.length(F.coalesce(own, F.lit(""))) + 100), F.lit(0))).first()[0]
    lists = F.broadcast(lists) if size <= BROADCAST_CHARS else lists
    between = F.when(F.col(own).isNull(), F.split(whole_text, ANY, -1)).otherwise(F.split(whole_text, F.col(own), F.lit(-1)))
    filled = F.array_join(F.flatten(F.zip_with(between, new, lambda a, b: F.array(a, F.coalesce(b, F.lit(""))))), "")
    out = known.join(lists, [p, q], "left")
    replaced = F.when(F.col(new).isNotNull(), filled).otherwise(whole_text)
    counted = [F.coalesce(F.col(number), F.lit(0).cast("long")).alias(count)] if count else []
    return out.select(*[replaced.alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns if c != count], *counted)


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return replace_pii(docs, spark.conf.get("spindrift.pii.key", None), count="n_entities")
