"""Personal data replaced by keyed surrogates, with DataFrame functions only.

One regular expression finds the entities. Their distinct values, never the occurrences, get surrogates from a keyed
hash: same type, script, gender and format. Surrogates that meet each other or a value that is really in the corpus
are drawn again until all differ, so equal entities stay equal and different ones different, in every document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reachworks.session import freeze

# Titles that announce a name, by the gender they tell (fixed values).
MALE = "Mr Sir Herr Monsieur Señor Sr Don господин г-н".split()
FEMALE = "Mrs Ms Miss Frau Madame Mme Mlle Señora Sra Srta Doña госпожа г-жа".split()
NEUTRAL = "Dr Prof Professor доктор профессор".split()

GIVEN = {
    ("latin", "m"): "Adam Brian Carl Daniel Erik Felix Georg Henry Ivan Jonas Karl Leon Marco Nils Oscar Paul Robert Simon Thomas Victor".split(),
    ("latin", "f"): "Alice Berta Clara Diana Elena Frida Greta Hanna Irene Julia Karin Laura Maria Nora Olivia Paula Rosa Sonja Teresa Vera".split(),
    ("latin", "n"): "Alex Charlie Jamie Jordan Kim Leslie Morgan Noel Robin Sam Taylor Toni".split(),
    ("cyrillic", "m"): "Андрей Борис Виктор Глеб Денис Егор Захар Игорь Кирилл Лев Максим Олег Павел Роман Степан Тимур".split(),
    ("cyrillic", "f"): "Алла Вера Галина Дарья Елена Жанна Зоя Ирина Клара Лидия Мария Нина Ольга Раиса Софья Тамара".split(),
    ("cyrillic", "n"): "Саша Женя Валя Слава".split(),
}
SYLLABLES = {"latin": "ba be bo da de do fa fe ga ge ha he ka ke la le lo ma me mo na ne no pa pe ra re ro sa se ta te to va ve wa we za".split(),
             "cyrillic": "ба бе бо ва ве во га го да де до за зе ка ко ла ле ло ма ме мо на не но па по ра ре ро са со та то".split()}
ENDINGS = {"latin": ["ll", "n", "r", "s", "th", "ck", "nd", "m"], "cyrillic": ["нов", "лов", "ров", "мин", "кин"]}

_TITLE = "(?:" + "|".join(sorted(MALE + FEMALE + NEUTRAL, key=lambda t: (-len(t), t))) + ")"
# Kind -> pattern; an earlier kind wins where two begin at the same place. Each first asks for the character that it
# begins with, so that most places of a text are passed at once. Every repeat of a group is bounded, an address as mail
# itself bounds it: Java's expressions go one call deeper with each.
PATTERNS = {
    "email": r"(?=[A-Za-z0-9._%+-])(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@(?:[A-Za-z0-9-]{1,63}\.){1,126}[A-Za-z]{2,63}",
    "iban": r"(?=[A-Z][A-Z][0-9])(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ssn": r"(?=[0-9])(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "card": r"(?=[0-9])(?<![0-9])(?:[0-9]{4}[ -]){3}[0-9]{1,7}(?![0-9])|(?=[0-9])(?<![0-9A-Za-z.])[0-9]{13,19}(?![0-9A-Za-z])",
    "ip": r"(?=[0-9])(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9])",
    "phone": r"(?=[+(0-9])(?<![0-9A-Za-z+])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)|[0-9]{2,4})[ .-]?[0-9]{3,4}[ .-][0-9]{3,4}(?![0-9])|(?=\+)(?<![0-9A-Za-z])\+[0-9]{8,15}(?![0-9])",
    "name": rf"(?=[{''.join(sorted({t[0] for t in MALE + FEMALE + NEUTRAL}))}])(?<![\p{{L}}\p{{N}}]){_TITLE}\.? \p{{Lu}}[\p{{L}}'’]+(?:[ -]\p{{Lu}}[\p{{L}}'’]+){{0,2}}",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())


def _sql(text: str) -> str:
    return text.replace("\\", "\\\\").replace("'", "\\'")


def _array(values: list[str]) -> str:
    return "array(" + ", ".join(f"'{_sql(v)}'" for v in values) + ")"


def entity_strings(text: str | Column) -> Column:
    """Every entity of a text in order, as written; empty for null."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(ANY), F.lit(0)), F.array().cast("array<string>"))


def _kind(surface: str) -> Column:
    out = None
    for kind, pattern in PATTERNS.items():
        # Looking around has been done in the text; here the whole string must be the entity.
        whole = F.col(surface).rlike(f"^(?:{pattern})$")
        out = F.when(whole, kind) if out is None else out.when(whole, kind)
    return out.otherwise("phone")


def _parts(surfaces: DataFrame) -> DataFrame:
    """(surface, at, kind, canon, piece, gender): what a surface is made of; a name's words are entities of their own,
    so that a family name alone is the same as within a full name."""
    title = rf"^{_TITLE}\\.? ".replace("\\\\", "\\")
    kinds = surfaces.withColumn("kind", _kind("surface"))
    digits = F.regexp_replace("surface", "[^0-9]", "")
    canon = (F.when(F.col("kind") == "email", F.lower("surface")).when(F.col("kind") == "iban", F.regexp_replace("surface", " ", ""))
             .when(F.col("kind") == "phone", F.when(F.length(digits) > 10, F.expr("right(regexp_replace(surface, '[^0-9]', ''), 10)")).otherwise(digits))
             .when(F.col("kind") == "ip", F.col("surface")).otherwise(digits))
    plain = kinds.where("kind <> 'name'").select("surface", F.lit(0).alias("at"), "kind", canon.alias("canon"), F.col("surface").alias("piece"), F.lit("n").alias("gender"))
    said = F.regexp_extract("surface", rf"^({_TITLE})\.? ", 1)
    gender = F.when(said.isin(*MALE), "m").when(said.isin(*FEMALE), "f").otherwise("n")
    words = F.split(F.regexp_replace("surface", title, ""), "[ -]")
    named = kinds.where("kind = 'name'").select("surface", gender.alias("gender"), F.size(words).alias("n"), F.posexplode(words).alias("at", "piece"))
    named = named.select("surface", "at", F.when(F.col("at") == F.col("n") - 1, "family").otherwise("given").alias("kind"), F.lower("piece").alias("canon"), "piece", "gender")
    return plain.unionByName(named)


_DRAW = "cast(conv(substring(sha2(concat(seed, '/', {i}), 256), 1, 8), 16, 10) as bigint)"


def _draw(i: str, n: int | str) -> str:
    return f"({_DRAW.format(i=i)} % {n})"


def _pick(values: list[str], i: str) -> str:
    return f"element_at({_array(values)}, cast({_draw(i, len(values))} + 1 as int))"


def _each(source: str, change: str) -> str:
    """Every character c of a string, at place i, changed; joined again."""
    return f"array_join(transform(sequence(1, greatest(length({source}), 1)), i -> {change.replace('{c}', f'substring({source}, i, 1)')}), '')"


_SAME_CLASS = (f"CASE WHEN {{c}} rlike '[0-9]' THEN cast({_draw('i', 10)} as string) WHEN {{c}} rlike '[a-z]' THEN substring('abcdefghijklmnopqrstuvwxyz', cast({_draw('i', 26)} as int) + 1, 1) "
               f"WHEN {{c}} rlike '[A-Z]' THEN substring('ABCDEFGHIJKLMNOPQRSTUVWXYZ', cast({_draw('i', 26)} as int) + 1, 1) ELSE {{c}} END")
_LUHN = ("aggregate(sequence(1, length({s})), 0, (a, i) -> a + CASE WHEN (length({s}) - i + {shift}) % 2 = 0 THEN cast(substring({s}, i, 1) as int) "
         "ELSE (cast(substring({s}, i, 1) as int) * 2) % 10 + cast(cast(substring({s}, i, 1) as int) * 2 >= 10 as int) END) % 10")
_MOD97 = ("aggregate(transform(sequence(1, length({s})), i -> ascii(substring({s}, i, 1))), 0, (a, x) -> "
          "CASE WHEN x < 65 THEN (a * 10 + x - 48) % 97 ELSE (a * 100 + x - 55) % 97 END)")


def _surrogates(pending: DataFrame, key: str, attempt: int) -> DataFrame:
    """A candidate for each (kind, canon, gender); a later attempt draws anew and, where few forms exist, longer ones.

    Names and the local part of an address grow with the attempt without end, so their forms outnumber any values.
    Numbers keep their digits, and thus have as many forms as their length allows.
    """
    df = pending.withColumn("seed", F.sha2(F.concat_ws("\x1f", F.lit(key), "kind", "canon", F.lit(str(attempt))), 256))
    df = df.withColumn("script", F.when(F.col("canon").rlike(r"\p{IsCyrillic}"), "cyrillic").otherwise("latin"))
    local, domain = "substring_index(canon, '@', 1)", "substring_index(canon, '@', -1)"
    # The host's own seed: addresses of one host stay at one host.
    host = (f"aggregate(array(1), '', (z, y) -> {_each(f'substring({domain}, 1, length({domain}) - length(substring_index({domain}, chr(46), -1)) - 1)', _SAME_CLASS.replace('seed', 'host_seed'))})")
    df = df.withColumn("host_seed", F.sha2(F.concat_ws("\x1f", F.lit(key), F.lit("host"), F.expr(domain)), 256))
    # A short name at a host has few forms of its own: letters are put behind it.
    more = "".join(f", substring('abcdefghijklmnopqrstuvwxyz', cast({_draw(f"'m{k}'", 26)} as int) + 1, 1)" for k in range(max(0, attempt - 3)))
    email = f"concat({_each(local, _SAME_CLASS)}{more}, '@', {host}, '.', substring_index({domain}, '.', -1))"
    number = _each("canon", f"CASE WHEN i = 1 THEN cast(2 + {_draw('i', 8)} as string) ELSE cast({_draw('i', 10)} as string) END")
    body = _each("substring(canon, 1, length(canon) - 1)", f"CASE WHEN i = 1 THEN {{c}} ELSE cast({_draw('i', 10)} as string) END")
    luhn_ok = f"{_LUHN.format(s='canon', shift=0)} = 0"
    df = df.withColumn("body", F.when(F.col("kind") == "card", F.expr(body)).when(F.col("kind") == "iban", F.expr(f"{_each('substring(canon, 5)', _SAME_CLASS)}")))
    card = f"concat(body, CASE WHEN {luhn_ok} THEN cast((10 - {_LUHN.format(s='body', shift=1)}) % 10 as string) ELSE cast({_draw('0', 10)} as string) END)"
    moved = "concat(body, substring(canon, 1, 2), '00')"
    iban = f"concat(substring(canon, 1, 2), lpad(cast(98 - {_MOD97.format(s=moved)} as string), 2, '0'), body)"
    octet = ("CASE length(o) WHEN 1 THEN 1 + {d} % 9 WHEN 2 THEN 10 + {d} % 90 ELSE 100 + {d} % 150 END" if attempt < 4 else "1 + {d} % 249").format(d=_DRAW.format(i="k"))
    ip = f"array_join(transform(split(canon, '[.]'), (o, k) -> cast({octet} as string)), '.')"
    given, family = None, None
    for script in ("latin", "cyrillic"):
        for gender in "mfn":
            names = GIVEN[script, gender]
            value = F.expr("concat_ws('-', " + ", ".join(_pick(names, f"'g{k}'") for k in range(1 + attempt)) + ")")
            here = (F.col("script") == script) & (F.col("gender") == gender)
            given = F.when(here, value) if given is None else given.when(here, value)
        value = F.expr("initcap(concat(" + ", ".join([*[_pick(SYLLABLES[script], f"'s{k}'") for k in range(2 + attempt)], _pick(ENDINGS[script], "'e'")]) + "))")
        if script == "cyrillic":
            value = F.when(F.col("canon").rlike("[ая]$"), F.concat(value, F.lit("а"))).otherwise(value)
        family = F.when(F.col("script") == script, value) if family is None else family.when(F.col("script") == script, value)
    made = (F.when(F.col("kind") == "email", F.expr(email)).when(F.col("kind") == "card", F.expr(card)).when(F.col("kind") == "iban", F.expr(iban))
            .when(F.col("kind") == "ip", F.expr(ip)).when(F.col("kind") == "given", F.lower(given)).when(F.col("kind") == "family", F.lower(family)).otherwise(F.expr(number)))
    return df.select("kind", "canon", "gender", made.alias("surrogate"))


def surrogate_table(entities: DataFrame, key: str) -> DataFrame:
    """(kind, canon, surrogate) for distinct (kind, canon, gender): surrogates differ from each other and from every canon of their kind."""
    pending, real = freeze(entities), entities.select("kind", F.col("canon").alias("surrogate"))
    taken, attempt, schema = None, 0, "kind string, canon string, surrogate string"
    while not pending.isEmpty():
        drawn = freeze(_surrogates(pending, key, attempt))
        free = drawn.join(real, ["kind", "surrogate"], "left_anti")
        if taken is not None:
            free = free.join(taken.select("kind", "surrogate"), ["kind", "surrogate"], "left_anti")
        won = freeze(free.groupBy("kind", "surrogate").agg(F.min("canon").alias("canon")).select("kind", "canon", "surrogate"))
        taken = won if taken is None else taken.unionByName(won)
        pending = freeze(pending.join(won, ["kind", "canon"], "left_anti"))
        attempt += 1
    return taken if taken is not None else entities.sparkSession.createDataFrame([], schema)


def _rendered() -> Column:
    """The surrogate in the dress of the piece: digits into its digit places from the right, capitals as it has them."""
    count = "length(regexp_replace({}, '[^0-9]', ''))"
    spare = f"({count.format('piece')} - length(surrogate))"
    filled = _each("piece", f"CASE WHEN {{c}} rlike '[0-9]' AND {count.format('substring(piece, 1, i)')} > {spare} "
                            f"THEN substring(surrogate, {count.format('substring(piece, 1, i)')} - {spare}, 1) ELSE {{c}} END")
    spaced = _each("piece", "CASE WHEN {c} = ' ' THEN ' ' ELSE substring(surrogate, length(replace(substring(piece, 1, i), ' ', '')), 1) END")
    upper = F.col("piece") == F.upper("piece")
    return (F.when(F.col("kind").isin("phone", "card", "ssn"), F.expr(filled)).when(F.col("kind") == "iban", F.expr(spaced))
            .when(F.col("kind") == "email", F.when(upper & F.col("piece").rlike("[A-Z]"), F.upper("surrogate")).otherwise(F.col("surrogate")))
            .when(F.col("kind").isin("given", "family"), F.when(upper, F.upper("surrogate")).otherwise(F.regexp_replace(F.initcap(F.regexp_replace("surrogate", "-", "- ")), "- ", "-")))
            .otherwise(F.col("surrogate")))


def replace_pii(docs: DataFrame, key: str, text: str = "text", entities: str = "pii_kinds") -> DataFrame:
    """All rows and columns, `text` with surrogates, and an array of the kinds replaced, in order.

    Null and empty texts, and texts without entities, stay as they are with an empty array; repeated rows are each
    replaced alike. The key decides all surrogates: the same key gives the same ones for the same set of entities.
    """
    has = F.coalesce(F.col(text).rlike(ANY), F.lit(False))
    clean = docs.where(~has).withColumn(entities, F.array().cast("array<string>"))
    rows = freeze(docs.where(has).select(F.struct(*docs.columns).alias("row"), entity_strings(text).alias("found")).withColumn("tag", F.monotonically_increasing_id()))
    surfaces = freeze(rows.select(F.explode("found").alias("surface")).distinct())
    parts = freeze(_parts(surfaces))
    genders = F.when(F.array_contains("said", "m") & F.array_contains("said", "f"), "n").when(F.array_contains("said", "m"), "m").when(F.array_contains("said", "f"), "f").otherwise("n")
    distinct = parts.groupBy("kind", "canon").agg(F.collect_set("gender").alias("said")).select("kind", "canon", genders.alias("gender"))
    table = surrogate_table(freeze(distinct), key)
    # Pieces of a surface in order, put back where they stood; other characters, such as a title, stay.
    drawn = parts.join(table, ["kind", "canon"]).select("surface", "at", "kind", "piece", _rendered().alias("new"))
    whole = drawn.groupBy("surface").agg(F.array_sort(F.collect_list(F.struct("at", "piece", "new", "kind"))).alias("p"))
    prefix = F.expr("substring(surface, 1, length(surface) - length(p[size(p) - 1].piece) - aggregate(slice(p, 1, size(p) - 1), 0, (a, x) -> a + length(x.piece) + 1))")
    gaps = F.expr("aggregate(p, named_struct('s', '', 'k', length(surface) - aggregate(p, -1, (a, x) -> a + length(x.piece) + 1) + 1), (a, x) -> named_struct("
                  "'s', concat(a.s, CASE WHEN x.at > 0 THEN substring(surface, a.k - 1, 1) ELSE '' END, x.new), 'k', a.k + length(x.piece) + 1)).s")
    news = freeze(whole.select("surface", F.concat(prefix, gaps).alias("new"), F.when(F.col("p")[0]["kind"].isin("given", "family"), "name").otherwise(F.col("p")[0]["kind"]).alias("kind")))
    at = rows.select("tag", F.posexplode("found").alias("at", "surface")).join(news, "surface")
    done = freeze(at.groupBy("tag").agg(F.array_sort(F.collect_list(F.struct("at", "new", "kind"))).alias("p")))
    pieces = F.split(F.col(f"row.{text}"), ANY, -1)
    joined = F.concat(F.array_join(F.zip_with(F.slice("bits", 1, F.size("p")), "p", lambda a, b: F.concat(a, b["new"])), ""), F.element_at("bits", -1))
    out = rows.join(done, "tag").withColumn("bits", pieces).withColumn("__new", joined)
    return clean.unionByName(out.select(*[F.col("__new").alias(text) if c == text else F.col(f"row.{c}").alias(c) for c in docs.columns], F.col("p.kind").alias(entities)))
