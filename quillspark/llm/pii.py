"""Personal data: keyed, type-consistent surrogates with corpus-wide collision checks, in DataFrame functions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import materialize, shuffle_parts, table

#: Key of the surrogates in the registered query; a real run passes its own secret.
KEY = "quillspark-demo-key"
#: Draws after which a type is taken to have no free surrogates left; then the run fails rather than merge two entities.
MAX_DRAWS = 64

MALE = ("Mr", "Herr", "Monsieur", "Señor", "Don", "Господин", "господин", "Κύριος")
FEMALE = ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Doña", "Госпожа", "госпожа", "Κυρία")
NEUTRAL = ("Dr", "Prof", "Доктор", "доктор")
_TITLES = "|".join(sorted((*MALE, *FEMALE, *NEUTRAL), key=len, reverse=True))
_NAME = r"(?:\p{Lu}')?\p{Lu}\p{Ll}+(?:-\p{Lu}\p{Ll}+)?"

PATTERNS = {
    # a label may give back hyphens and what follows them, never part of a word
    "email": r"(?<![A-Za-z0-9._%+\-\p{L}\p{M}])[A-Za-z0-9._%+\-\p{L}\p{M}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+(?![A-Za-z0-9]))*(?<=\.[A-Za-z]{2,24})",
    "secret": r"(?<![A-Za-z0-9])AKIA[0-9A-Z]{16}(?![A-Za-z0-9])|(?<![A-Za-z0-9])(?:ghp_|sk-)[A-Za-z0-9]{20,}"
    # the first two look-arounds only spare most places the third
    r"|(?<=[=:\s\"'])(?=[A-Za-z0-9+/_-]{8})(?<=(?i:password|passwd|token|secret|api_key|apikey)[\"']?\s{0,2}[=:]\s{0,2}[\"']?)[A-Za-z0-9+/_-]{8,}",
    "person": rf"(?<!\p{{L}})(?:{_TITLES})\.? {_NAME}(?: {_NAME})?",
    "iban": r"(?<![\w])[A-Z]{2}\d{2} ?(?:[A-Z]{4}|\d{4})(?: ?\d{4}){1,6}(?: ?\d{1,4})?(?![\w])",
    "card": r"(?<![\w.])(?:\d{13,19}|\d{4}(?:[ -]\d{4}){3}|\d(?:[ -]?\d){12,18})(?![\w])",
    "ssn": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
    "ip": r"(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?![\w]|\.\d)",
    "phone": r"(?<![\w+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{3}\)|\d{3})[ .-]\d{3}[ .-]\d{4}(?![\w])|(?<![\w])\+\d{1,3}(?:[ .-]?\d{2,4}){2,5}(?![\w])",
}
_ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: What every match of the patterns holds (a test proves it); texts without it skip the full pattern. Keys may lack digits. The titles' first letters
#: come first, as a position fails on them at once.
_HINT = rf"[0-9@=:]|AKIA|ghp_|sk-|(?<!\p{{L}})(?=[{''.join(sorted({t[0] for t in (*MALE, *FEMALE, *NEUTRAL)}))}])(?:{_TITLES})\.? \p{{Lu}}"

#: Given names by script and gender; surnames are built from the syllables, so they never run out.
GIVEN = {
    "latin": {"m": ("Adam", "Bruno", "Carl", "David", "Emil", "Felix", "Hugo", "Julian", "Leon", "Martin", "Oscar", "Victor"),
              "f": ("Alma", "Bella", "Clara", "Diana", "Emma", "Flora", "Helena", "Julia", "Laura", "Maria", "Olivia", "Vera")},
    "cyrillic": {"m": ("Антон", "Борис", "Виктор", "Глеб", "Денис", "Иван", "Кирилл", "Максим", "Олег", "Павел"),
                 "f": ("Анна", "Вера", "Дарья", "Елена", "Ирина", "Мария", "Нина", "Ольга", "Софья", "Юлия")},
    "greek": {"m": ("Ανδρέας", "Γιώργος", "Δημήτρης", "Κώστας", "Νίκος", "Πέτρος"),
              "f": ("Άννα", "Ελένη", "Ειρήνη", "Κατερίνα", "Μαρία", "Σοφία")},
}
SYLLABLES = {
    "latin": ("ba", "den", "fel", "gor", "han", "kel", "lin", "mar", "nor", "per", "ros", "sal", "tan", "vel", "win", "zor"),
    "cyrillic": ("ба", "вер", "гор", "дам", "зор", "кал", "лин", "мар", "нов", "пет", "рос", "сам", "тар", "фед", "хол", "чер"),
    "greek": ("βα", "γερ", "δαμ", "καλ", "λιν", "μαρ", "νικ", "παπ", "ρος", "σαμ", "ταρ", "φιλ", "χαρ", "θεο", "ζορ", "κον"),
}


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _alnum(c: Column) -> Column:
    return F.regexp_replace(c, "[^A-Za-z0-9]", "")


def _luhn(digits: Column) -> Column:
    """Luhn sum of a digit string modulo 10; its last digit is the check digit."""
    n = F.length(digits)
    each = F.transform(
        F.sequence(F.lit(1), n),
        lambda i: F.when((n - i) % 2 == 1, F.substring(digits, i, F.lit(1)).cast("int") * 2 - F.when(F.substring(digits, i, F.lit(1)) > "4", 9).otherwise(0)).otherwise(
            F.substring(digits, i, F.lit(1)).cast("int")
        ),
    )
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10


def _mod97(alnum: Column) -> Column:
    """A string of digits and A-Z modulo 97, letters as 10 to 35."""
    step = lambda a, c: F.when(c.between("0", "9"), (a * 10 + c.try_cast("int")) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97)
    return F.aggregate(F.regexp_extract_all(F.upper(alnum), F.lit("."), F.lit(0)), F.lit(0), step)


def _kind(e: Column) -> Column:
    """Type of a matched string; null where it is no valid entity (a failed check sum, an octet over 255, a mere line)."""
    whole = lambda k: e.rlike(f"^(?:{PATTERNS[k]})$")
    octets = F.forall(F.split(e, r"\."), lambda x: x.cast("int") <= 255)
    return (
        F.when(e.contains("@"), "email")
        .when(whole("person"), "person")
        .when(whole("iban"), "iban")
        .when(whole("ssn"), "ssn")
        .when(whole("ip"), F.when(octets, "ip"))
        .when(whole("phone"), "phone")
        .when(whole("card"), F.when(_luhn(_digits(e)) == 0, "card"))
        .when(e.rlike("[A-Za-z0-9]"), "secret")
    )


def _script(word: Column) -> Column:
    return F.when(word.rlike(r"\p{IsCyrillic}"), "cyrillic").when(word.rlike(r"\p{IsGreek}"), "greek").otherwise("latin")


def _gender(person: Column) -> Column:
    title = F.regexp_extract(person, rf"^({_TITLES})", 1)
    return F.when(title.isin(*MALE), "m").when(title.isin(*FEMALE), "f").otherwise("n")


def _names(person: Column) -> Column:
    return F.split(F.regexp_replace(person, rf"^(?:{_TITLES})\.? ", ""), " ")


def _stem(word: Column, gender: Column) -> Column:
    """Key of a surname: a woman's Slavic surname has the key of the man's form."""
    female = (gender == "f") & word.rlike(r"\p{IsCyrillic}")
    return F.lower(F.when(female, F.regexp_replace(word, "а$", "")).otherwise(word))


def _parts(kind: Column, e: Column) -> Column:
    """What of an entity gets a surrogate of its own: (type, key) of each part."""
    names, gender = _names(e), _gender(e)
    last = F.struct(F.concat(F.lit("surname:"), _script(F.element_at(names, -1))).alias("type"), _stem(F.element_at(names, -1), gender).alias("key"))
    first = F.struct(F.concat(F.lit("given:"), _script(names[0]), F.lit(":"), gender).alias("type"), F.lower(names[0]).alias("key"))
    plain = F.when(kind == "email", F.lower(e)).when(kind.isin("card", "phone", "ssn", "iban"), _alnum(e)).otherwise(e)
    domain = F.struct(F.lit("domain").alias("type"), F.substring_index(F.lower(e), "@", -1).alias("key"))
    return (
        F.when(kind == "person", F.when(F.size(names) > 1, F.array(first, last)).otherwise(F.array(last)))
        .when(kind == "email", F.array(F.struct(kind.alias("type"), plain.alias("key")), domain))
        .when(kind.isNotNull(), F.array(F.struct(kind.alias("type"), plain.alias("key"))))
        .otherwise(F.array().cast("array<struct<type:string,key:string>>"))
    )


def _draw(key: str, type_: Column, entity: Column, attempt: int) -> Column:
    """128 hexadecimal digits that depend on the secret, the type, the entity and the draw."""
    seed = F.concat_ws("\u0001", F.lit(key), type_, entity, F.lit(str(attempt)))
    return F.concat(F.sha2(F.concat(seed, F.lit("a")), 256), F.sha2(F.concat(seed, F.lit("b")), 256))


def _at(hexes: Column, i: Column, base: int) -> Column:
    """A number below ``base`` from the i-th place of the drawn digits."""
    return F.conv(F.substring(hexes, (i * 7) % 121 + 1, F.lit(7)), 16, 10).cast("long") % base


def _in_shape(word: Column, hexes: Column) -> Column:
    """Each digit to a digit, each letter to a letter of its case (of a hexadecimal word, to such a letter), others as they are.

    Letters beyond A-Z become lower-case ones: Cyrillic or Greek if they are so, else of a-z.
    """
    one = lambda i: F.substring(word, i, F.lit(1))
    pick = lambda chars, i: F.substring(F.lit(chars), (_at(hexes, i, len(chars)) + 1).cast("int"), F.lit(1))
    return F.when(F.length(word) == 0, F.lit("")).otherwise(
        F.array_join(
            F.transform(
                F.sequence(F.lit(1), F.greatest(F.length(word), F.lit(1))),
                lambda i: F.when(one(i).rlike("[0-9]"), pick("0123456789", i))
                .when(one(i).rlike("[a-z]"), F.when(word.rlike("^[0-9a-f]{12,}$"), pick("abcdef", i)).otherwise(pick("abcdefghijklmnopqrstuvwxyz", i)))
                .when(one(i).rlike("[A-Z]"), pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ", i))
                .when(one(i).rlike(r"\p{IsCyrillic}"), pick("абвгдежзиклмнопрстуфхцчшэюя", i))
                .when(one(i).rlike(r"\p{IsGreek}"), pick("αβγδεζηθικλμνξοπρστυφχψω", i))
                .when(one(i).rlike(r"\p{L}"), pick("abcdefghijklmnopqrstuvwxyz", i))
                .otherwise(one(i)),
            ),
            "",
        )
    )


def _candidate(secret: str, attempt: int) -> Column:
    """The surrogate of (type, key) at this draw. Later draws widen short forms, so distinct ones always exist."""
    t, k = F.col("type"), F.col("key")
    h = _draw(secret, t, k, attempt)
    tail = F.substring(_in_shape(F.lit("0" * 20), h), F.lit(1), F.lit(attempt))
    # an address is drawn within its domain, and the domain by itself
    email = F.concat(_in_shape(F.substring_index(k, "@", 1), h), tail, F.lit("@"), F.substring_index(k, "@", -1))
    tld = F.substring_index(k, ".", -1)
    letters = F.substring(_in_shape(F.lit("a" * 20), h), F.lit(1), F.lit(attempt))
    domain = F.concat(_in_shape(F.substring(k, F.lit(1), F.length(k) - F.length(tld) - 1), h), letters, F.lit("."), tld)
    n = F.length(k)
    body = F.concat(F.substring(k, F.lit(1), F.lit(1)), F.substring(_in_shape(k, h), F.lit(2), n - 2))
    card = F.concat(body, ((10 - _luhn(F.concat(body, F.lit("0")))) % 10).cast("string"))
    prefix = F.greatest(n - 10, F.lit(0))
    phone = F.concat(F.substring(k, F.lit(1), prefix), (_at(h, F.lit(77), 8) + 2).cast("string"), F.substring(_in_shape(k, h), prefix + 2, n))
    ssn = F.concat((_at(h, F.lit(78), 8) + 1).cast("string"), F.substring(_in_shape(k, h), F.lit(2), n))
    ip = F.concat_ws(".", *[(_at(h, F.lit(80 + i), 223 if i == 0 else 254) + 1).cast("string") for i in range(4)])
    country, account = F.substring(k, F.lit(1), F.lit(2)), F.substring(_in_shape(k, h), F.lit(5), n)
    iban = F.concat(country, F.lpad((98 - _mod97(F.concat(account, country, F.lit("00")))).cast("string"), 2, "0"), account)
    kept = F.regexp_extract(k, "^(?:AKIA|ghp_|sk-)", 0)
    out = (
        F.when(t == "email", email).when(t == "domain", domain).when(t == "card", card).when(t == "phone", phone).when(t == "ssn", ssn).when(t == "ip", ip)
        .when(t == "iban", iban).when(t == "secret", F.concat(kept, F.substring(_in_shape(k, h), F.length(kept) + 1, n)))
    )
    for script, syllables in SYLLABLES.items():
        pick = lambda i, s=syllables: F.element_at(F.array(*map(F.lit, s)), (_at(h, F.lit(i), len(s)) + 1).cast("int"))
        family = F.concat(*[pick(40 + i) for i in range(3 + attempt)])
        out = out.when(t == f"surname:{script}", F.concat(F.initcap(family), F.lit("ов" if script == "cyrillic" else "")))
        for gender in ("m", "f", "n"):
            pool = GIVEN[script].get(gender) or GIVEN[script]["m"] + GIVEN[script]["f"]
            name = F.element_at(F.array(*map(F.lit, pool)), (_at(h, F.lit(30), len(pool)) + 1).cast("int"))
            more = F.initcap(F.concat(*[pick(60 + i) for i in range(attempt)])) if attempt else None
            out = out.when(t == f"given:{script}:{gender}", name if more is None else F.concat(name, F.lit("-"), more))
    return out


def surrogates(entities: DataFrame, secret: str) -> DataFrame:
    """A surrogate for each distinct (type, key): rows (type, key, surrogate).

    Two entities of a type never share a surrogate, and no surrogate is itself an entity of that type found in
    the corpus. An entity whose draw collides draws again; of those that collide with each other the smallest
    keeps the draw. Fails after MAX_DRAWS draws.
    """
    space = F.regexp_extract("type", "^[a-z]+(?::[a-z]+)?", 0)
    entities = materialize(entities.distinct().withColumn("space", space), "entities")
    parts = shuffle_parts(entities.sparkSession)
    done, pending = [], entities
    for attempt in range(MAX_DRAWS):
        # few rows, much work for each: dealt out, as they may come in one small file
        drawn = pending.repartition(parts, "type", "key").withColumn("surrogate", _candidate(secret, attempt))
        taken = entities.select("space", F.when(F.col("type").startswith("given") | F.col("type").startswith("surname"), F.initcap("key")).otherwise(F.col("key")).alias("surrogate"))
        taken = reduce(DataFrame.unionByName, [d.select("space", "surrogate") for d in done], taken).distinct()
        free = drawn.join(taken, ["space", "surrogate"], "left_anti")
        won = free.groupBy("space", "surrogate").agg(F.min(F.struct("type", "key")).alias("e")).select("e.type", "e.key", "space", "surrogate")
        won = materialize(won, "surrogates")
        done.append(won)
        pending = materialize(pending.join(won, ["type", "key"], "left_anti"), "pending")
        if pending.isEmpty():
            return reduce(DataFrame.unionByName, done).select("type", "key", "surrogate")
    raise ValueError("no free surrogates are left for some entities")


def one_person(entities: DataFrame, secret: str) -> DataFrame:
    """``surrogates``, with given names after a neutral title as after the man's or woman's title that the name has
    elsewhere in the corpus (of both, the woman's); without one they are drawn from all names."""
    entities = entities.distinct()
    base = F.regexp_extract("type", "^(given:[a-z]+):", 1).alias("base")
    gendered = entities.where(F.col("type").rlike("^given:[a-z]+:[mf]$")).groupBy(base, "key").agg(F.min("type").alias("as_type"))
    neutral = entities.where(F.col("type").rlike("^given:[a-z]+:n$")).select(base, "type", "key")
    other = materialize(neutral.join(gendered, ["base", "key"]).select("type", "key", "as_type"), "neutral-names")
    mapping = surrogates(entities.join(other, ["type", "key"], "left_anti"), secret)
    named = mapping.withColumnRenamed("type", "as_type").join(other, ["as_type", "key"])
    return mapping.unionByName(named.select("type", "key", "surrogate"))


def _layout(original: Column, fill: Column) -> Column:
    """``fill`` laid out with the separators of ``original``."""
    chars = F.transform(
        F.sequence(F.lit(1), F.length(original)),
        lambda i: F.when(
            F.substring(original, i, F.lit(1)).rlike("[A-Za-z0-9]"),
            F.substring(fill, F.length(_alnum(F.substring(original, F.lit(1), i))), F.lit(1)),
        ).otherwise(F.substring(original, i, F.lit(1))),
    )
    return F.array_join(chars, "")


def _titled(entity: Column) -> Column:
    """The string of an entity struct; an untitled name with the title that it goes by elsewhere in its text."""
    return F.concat(F.coalesce(entity["title"], F.lit("")), entity["e"])


def _render(entity: Column, held: Column) -> Column:
    """The text that stands for an entity struct (kind, e, title); ``held`` maps type:key to surrogates."""
    kind, e, whole = entity["kind"], entity["e"], _titled(entity)
    of = F.transform(_parts(kind, whole), lambda p: held[F.concat_ws(":", p["type"], p["key"])])
    title = F.regexp_extract(e, rf"^(?:{_TITLES})\.? ", 0)
    female = (_gender(whole) == "f") & e.rlike(r"\p{IsCyrillic}$")
    address = F.concat(F.substring_index(of[0], "@", 1), F.lit("@"), F.get(of, 1))
    return (
        F.when(kind.isNull(), e)
        .when(kind == "person", F.concat(title, F.array_join(of, " "), F.when(female, "а").otherwise("")))
        .when(kind.isin("card", "phone", "ssn", "iban"), _layout(e, of[0]))
        .when(kind == "email", F.when(e == F.upper(e), F.upper(address)).otherwise(address))
        .otherwise(of[0])
    )


def _name_pattern(titles: Column) -> Column:
    """A pattern of the untitled names that are the keys of ``titles``; the longest come first."""
    longest_first = F.array_sort(F.map_keys(titles), lambda a, b: F.length(b) - F.length(a))
    return F.concat(F.lit(r"|(?<![\p{L}\p{M}])(?:"), F.array_join(longest_first, "|"), F.lit(r")(?![\p{L}\p{M}])"))


def _untitled(found: Column) -> Column:
    """The names that a text's titled persons go by without their title, each with that title."""
    persons = F.filter(found, lambda e: e.rlike(rf"^(?:{_TITLES})\.? {_NAME}"))
    title = lambda e: F.regexp_extract(e, rf"^(?:{_TITLES})\.? ", 0)
    whole = F.transform(persons, lambda e: F.struct(F.array_join(_names(e), " ").alias("key"), title(e).alias("value")))
    last = F.transform(persons, lambda e: F.struct(F.element_at(_names(e), -1).alias("key"), title(e).alias("value")))
    both = F.concat(whole, last)
    # of several titles of a name the first counts
    first = F.filter(both, lambda x, i: F.array_position(F.transform(both, lambda y: y["key"]), x["key"]) == i + 1)
    return F.map_from_entries(first)


def surrogate_texts(docs: DataFrame, secret: str = KEY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Replace the personal data in ``text_col`` by surrogates; all columns stay, ``n_entities`` int is added.

    Found: e-mail and IPv4 addresses, phone, card (Luhn-valid), social security and account numbers, credentials
    and titled names (Latin, Cyrillic, Greek); in a text with a titled name also that name without its title and its
    bare surname. The same entity gets the same surrogate in every document and in every spelling of its separators;
    a surname keeps its surrogate with or without a given name or title. Digits stay digits, letters letters,
    separators stay; check digits of cards and accounts hold; names keep gender and script, and a person with a neutral
    title the gender of their other titles. Addresses of one domain share its surrogate, and domains stay distinct.
    Null texts stay null with 0 entities, as do texts without an entity; an empty table stays empty; rows that
    share or lack an id are handled one by one, as ``id_col`` is not read. A column n_entities of the input is replaced.
    Rows with entities are written once, cut at their entities; the others pass straight through.
    """
    docs = docs.drop("n_entities")
    columns = docs.columns
    hinted = F.coalesce(F.col(text_col).rlike(_HINT), F.lit(False))
    # nulls must land on one side; a text with the hint alone may still lack an entity
    plain = docs.where(~(hinted & (F.regexp_count(F.col(text_col), F.lit(_ANY)) > 0))).withColumn("n_entities", F.lit(0))
    # whatever the input's columns are called, they travel in one
    rest = F.struct(F.lit(True).alias("kept"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(columns) if c != text_col])
    text = F.col("text")
    # explode keeps each step from being computed again for the next
    once = lambda df, column, name: df.select("*", F.explode(F.array(column)).alias(name))
    hints = docs.where(hinted).select(rest.alias("rest"), F.col(text_col).alias("text"))
    marked = once(hints, F.regexp_extract_all(text, F.lit(_ANY), F.lit(0)), "_found").where(F.size("_found") > 0)
    marked = once(marked, _untitled(F.col("_found")), "_titles")
    named = F.size(F.map_keys("_titles")) > 0
    pattern = F.when(named, F.concat(F.lit(_ANY), _name_pattern(F.col("_titles")))).otherwise(F.lit(_ANY))
    marked = once(marked, pattern, "_pattern")
    marked = marked.withColumn("_found", F.when(named, F.regexp_extract_all(text, F.col("_pattern"), F.lit(0))).otherwise(F.col("_found")))

    def entity(e: Column) -> Column:
        title = F.try_element_at(F.col("_titles"), e)
        kind = F.when(title.isNotNull(), F.lit("person")).otherwise(_kind(e))
        return F.struct(kind.alias("kind"), e.alias("e"), title.alias("title"))

    marked = marked.select(
        "rest", F.transform("_found", entity).alias("_e"), F.split(text, F.col("_pattern"), -1).alias("_gaps"), F.monotonically_increasing_id().alias("_row")
    )
    marked = materialize(marked, "marked")  # from here on a row is known by its number
    parts = F.explode(_parts(F.col("_e.kind"), _titled(F.col("_e"))))
    found = marked.select("_row", F.explode(F.array_distinct("_e")).alias("_e")).select("_row", parts.alias("p")).select("_row", "p.type", "p.key").distinct()
    found = materialize(found, "found")
    mapping = one_person(found.select("type", "key"), secret)
    held = (
        found.join(mapping, ["type", "key"])
        .groupBy("_row")
        .agg(F.map_from_entries(F.collect_set(F.struct(F.concat_ws(":", "type", "key"), "surrogate"))).alias("_held"))
    )
    joined = marked.join(held, "_row", "left").withColumn("_held", F.coalesce("_held", F.create_map().cast("map<string,string>")))
    new = F.transform("_e", lambda x: _render(x, F.col("_held")))
    rebuilt = F.array_join(F.transform("_gaps", lambda g, i: F.concat(g, F.coalesce(F.try_element_at(new, i + 1), F.lit("")))), "")
    count = F.size(F.filter("_e", lambda x: x["kind"].isNotNull()))
    back = [rebuilt.alias(c) if c == text_col else F.col(f"rest.c{i}").alias(c) for i, c in enumerate(columns)]
    changed = joined.select(*back, count.alias("n_entities"))
    return plain.unionByName(changed)


def op1_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with surrogates in its text: doc_id, text, n_entities. Cases as in ``surrogate_texts``."""
    return surrogate_texts(table(spark, sf_dir, "documents", "doc_id", "text"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the columns of ``docs``, whatever they are called, with surrogates in the texts and ``n_chars``
    counted anew."""
    columns = docs.columns
    aside = "n_entities"
    while aside in columns:
        aside += "_"
    out = surrogate_texts(docs.withColumnRenamed("n_entities", aside) if aside != "n_entities" else docs).drop("n_entities")
    out = out.withColumnRenamed(aside, "n_entities") if aside != "n_entities" else out
    out = out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in columns else out
    return out.select(*[F.col(f"`{c}`") for c in columns])
