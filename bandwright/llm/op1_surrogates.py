"""Surrogates for personal data, in DataFrame operations only.

Entities (e-mail, IBAN, card, phone, social security and IP numbers, names
after an honorific) are found in whole texts by one pattern, leftmost first.
Names found so anywhere in the corpus are then looked for without honorific: a
given and a family name side by side in any text, and each name alone in the
texts that have it with an honorific. Each distinct entity of the corpus gets
one surrogate that depends on the key:

* cards, phones and social security numbers: a keyed swap-or-not permutation of
  all numbers of that length, put into the digits of each mention, so every
  mention keeps its own format; cards end in a valid check digit;
* IBANs: keyed letters for letters and digits for digits after the country,
  with valid check digits;
* IP addresses: the permutation over 32 bits as four octets; IPv6: keyed groups;
* e-mails: a name in the script of the local part, with a number, at the
  surrogate of the domain, which is an entity of its own;
* names: made-up names of the same script; each word of a name is an entity, so
  ``Mrs. Ada Byron``, ``Mrs. Byron`` and ``Ada Byron`` stay the same person. A
  word that is only ever the given name after a female (male) honorific gets an
  ending of that gender; capitals follow the mention.

Collision checks: a surrogate that two entities share, or that is an entity of
the corpus itself, is drawn again with the next attempt until none is left, so
distinct entities stay distinct and mentions of one keep one surrogate. (Where
most numbers of a length are entities, free ones run out; then all numbers of
that length are permuted among themselves.)

Only rows with entities are shuffled: they meet their surrogates by the digest
of their text. Lists of names and of text hashes are broadcast only when counted
and at most ``BROADCAST_ROWS``. Defined results: a null text stays null with no
entities; an empty text stays empty; repeated rows get equal texts; rows may
share an id; an empty table gives an empty result; other columns are ignored;
the key may be any text.

Not found: names never written with an honorific, names of more than three
words after one, card numbers of other lengths than 15 and 16 digits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bandwright.llm.store import written

# Honorifics by gender, patterns by kind in the order in which they are tried at a place, country calling codes.
HONORIFICS = {
    "f": "Mrs MRS Ms Miss MISS Frau FRAU Señora Sra Doña Madame Mme Mlle Dra г-жа госпожа Κυρία",
    "m": "Mr MR Herrn Herr HERR Señor Sr Monsieur Sir г-н господин Κύριος",
    "": "Dr DR Prof PROF Professor Doctor Doktor Docteur",
}
HONORIFIC = "(?:" + "|".join(sorted(" ".join(HONORIFICS.values()).split(), key=lambda w: (-len(w), w))) + r")\.?"
NAME = r"\p{Lu}[\p{L}'-]{1,40}"
CODE = r"^\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3})"
KINDS = (
    ("email", r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]{1,64}@[\p{L}\p{N}](?:[\p{L}\p{N}-]{0,62})(?:\.[\p{L}\p{N}][\p{L}\p{N}-]{0,62}){1,8}"),
    ("iban", r"(?<![\p{L}\p{N}])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])"),
    ("card", r"(?<![\p{L}\p{N}])(?:[0-9]{4}(?:[ -]?[0-9]{4}){3}|3[47][0-9]{2}[ -]?[0-9]{6}[ -]?[0-9]{5})(?![\p{L}\p{N}])"),
    ("ssn", r"(?<![\p{L}\p{N}-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\p{L}\p{N}-])"),
    ("ip", r"(?<![\p{L}\p{N}.])(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])){3}(?!\.?[\p{L}\p{N}])"),
    ("ipv6", r"(?<![\p{L}\p{N}:.])(?=[0-9A-Fa-f:]{0,39}[0-9])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6})(?![\p{L}\p{N}:])"),
    ("phone", r"(?<![\p{L}\p{N}+])(?:\+(?=(?:[ .()-]{0,2}[0-9]){7,15}(?![0-9]))[0-9]{1,4}(?:[ .-]?\([0-9]{1,4}\))?(?:[ .-]?[0-9]{2,8}){1,4}|\([0-9]{2,4}\)[ .-]?[0-9]{2,4}[ .-]?[0-9]{3,4}|[0-9]{3}[ .-][0-9]{3}[ .-][0-9]{4})(?![\p{L}\p{N}])"),
    ("name", rf"(?<![\p{{L}}\p{{N}}]){HONORIFIC} {NAME}(?: {NAME}){{0,2}}"),
)
PAIR = rf"(?<![\p{{L}}\p{{N}}'-]){NAME}(?= ({NAME}))"
SYLLABLES = {
    "Latin": "ba be bi bo da de di do fa fe ga ge ka ke la le li lo ma me mi mo na ne ni no ra re ri ro sa se ta te ti to va ve vi vo za",
    "Cyrillic": "ба бе би бо ва ве ви во да де ди до ка ке ла ле ли ло ма ме ми мо на не ни но ра ре ри ро са се та те ти то",
    "Greek": "βα βε βι γα γε δα δε δι κα κε λα λε λι μα με μι να νε νι ρα ρε ρι σα σε τα τε τι",
}
ENDINGS = {"Latin": ("na", "nus", "ner"), "Cyrillic": ("на", "н", "ко"), "Greek": ("να", "νος", "κης")}
ROUNDS = 16
ATTEMPTS = 24
BROADCAST_ROWS = 200_000
PATTERN = "|".join(p for _, p in KINDS)
#: What every mention holds: a digit, an at sign, a double colon or an honorific and a blank. Texts without it are not searched.
TRIGGER = rf"[0-9@]|::|{HONORIFIC} "


def _quoted(x: str) -> str:
    """A text as SQL literal."""
    return "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _draw(key: str, *parts: str) -> str:
    """60 keyed pseudorandom bits for the SQL strings ``parts``."""
    return f"cast(conv(substr(sha2(concat_ws('|', {_quoted(key)}, {', '.join(parts)}), 256), 1, 15), 16, 10) as bigint)"


def _permuted(x: str, n: str, key: str, kind: str) -> str:
    """A keyed permutation of [0, n) applied to x (swap-or-not)."""
    other = f"pmod({_draw(key, kind, 'attempt', 'r')} % ({n}) - x, {n})"
    bit = f"pmod({_draw(key, kind, 'attempt', 'r', f'greatest(x, {other})')}, 2) = 1"
    return f"aggregate(sequence(1, {ROUNDS}), try_cast({x} as bigint), (x, r) -> if({bit}, {other}, x))"


def _made_up(key: str, canon: str, script: str, ending: str) -> str:
    """Four syllables, one more every fourth attempt, and an ending in the script; all syllables have two letters."""
    parts = []
    for name, syllables in SYLLABLES.items():
        pool = syllables.split()
        array = "array(" + ", ".join(f"'{s}'" for s in pool) + ")"
        word = ", ".join(f"element_at({array}, cast({_draw(key, canon, 'attempt', str(i))} % {len(pool)} as int) + 1)" for i in range(10))
        ends = "array(" + ", ".join(f"'{e}'" for e in ENDINGS[name]) + ")"
        parts.append(f"WHEN {script} = '{name}' THEN concat(substr(concat({word}), 1, 2 * (4 + attempt div 4)), element_at({ends}, {ending}))")
    return f"CASE {' '.join(parts)} END"


def _script(x: str) -> str:
    return rf"CASE WHEN regexp({x}, '\\p{{IsCyrillic}}') THEN 'Cyrillic' WHEN regexp({x}, '\\p{{IsGreek}}') THEN 'Greek' ELSE 'Latin' END"


def surrogate(key: str) -> str:
    """SQL for the canonical surrogate of (kind, canon, gender) at ``attempt``."""

    stream = f"concat(sha2(concat_ws('|', {_quoted(key)}, kind, canon, attempt, 'a'), 256), sha2(concat_ws('|', {_quoted(key)}, kind, canon, attempt, 'b'), 256))"
    value = "cast(conv(substr(h, 2 * (i % 64) + 1, 2), 16, 10) as int)"

    def digits(x: str) -> str:
        """A permutation of the numbers of x's length; beyond bigint, keyed digits."""
        permuted = f"lpad(cast({_permuted(x, f'try_cast(rpad(1, length({x}) + 1, 0) as bigint)', key, 'kind')} as string), length({x}), '0')"
        return f"CASE WHEN length({x}) <= 18 THEN {permuted} ELSE transform(array({stream}), h -> array_join(transform(split({x}, ''), (c, i) -> cast({value} % 10 as string)), ''))[0] END"

    payload = digits("substr(canon, 1, length(canon) - 1)")
    # each second digit from the right counts double, with its digits summed
    luhn = "transform(array({x}), n -> concat(n, pmod(10 - aggregate(transform(split(reverse(n), ''), (c, i) -> if(i % 2 = 0, cast(c as int) * 2 - if(cast(c as int) > 4, 9, 0), cast(c as int))), 0, (s, d) -> s + d) % 10, 10)))[0]"
    card = f"CASE WHEN attempt < {ATTEMPTS} THEN {luhn.format(x=payload)} ELSE {digits('canon')} END"
    octet = "cast(split(canon, '[.]')[{}] as bigint)"
    address = " + ".join(f"{octet.format(i)} * {256 ** (3 - i)}" for i in range(4))
    dotted = f"transform(array({_permuted(f'({address})', '4294967296', key, 'kind')}), v -> concat_ws('.', v div 16777216, v div 65536 % 256, v div 256 % 256, v % 256))[0]"
    groups = f"transform(array({stream}), h -> concat_ws(':', concat('fd', substr(h, 1, 2)), transform(sequence(1, 7), i -> substr(h, 4 * i + 1, 4))))[0]"
    account = f"transform(array({stream}), h -> array_join(transform(split(substr(canon, 5), ''), (c, i) -> if(c rlike '[0-9]', cast({value} % 10 as string), char(65 + {value} % 26))), ''))[0]"
    # the remainder by 97 of account, country and 00, with letters as numbers from 10
    rest = "aggregate(split(concat(b, substr(canon, 1, 2), '00'), ''), 0, (s, c) -> if(c rlike '[0-9]', s * 10 + cast(c as int), s * 100 + ascii(c) - 55) % 97)"
    iban = f"transform(array({account}), b -> concat(substr(canon, 1, 2), lpad(cast(98 - {rest} as string), 2, '0'), b))[0]"
    email = f"concat({_made_up(key, 'canon', _script('canon'), '3')}, '.', {_draw(key, 'canon', 'attempt', chr(39) + 'n' + chr(39))} % 10000)"
    domain = f"concat('d', substr({stream}, 1, 8), '.example.', element_at(array('com', 'net', 'org'), cast({_draw(key, 'canon')} % 3 as int) + 1))"
    name = _made_up(key, "canon", _script("canon"), "CASE gender WHEN 'f' THEN 1 WHEN 'm' THEN 2 ELSE 3 END")
    return f"CASE kind WHEN 'email' THEN {email} WHEN 'domain' THEN {domain} WHEN 'ip' THEN {dotted} WHEN 'ipv6' THEN {groups} WHEN 'iban' THEN {iban} WHEN 'name' THEN {name} WHEN 'card' THEN {card} ELSE {digits('canon')} END"


def _kind(x: Column) -> Column:
    """The kind of a match, from its form."""
    forms = {"ipv6": "^[0-9A-Fa-f]*:", "iban": "^[A-Z]{2}[0-9]{2}", "card": "^[0-9]{4}(?:[ -]?[0-9]{4}){3}$|^3[47][0-9]{2}[ -]?[0-9]{6}[ -]?[0-9]{5}$", "ssn": "^[0-9]{3}-[0-9]{2}-[0-9]{4}$", "ip": r"^[0-9]{1,3}(?:\.[0-9]{1,3}){3}$", "phone": "^[+(0-9]"}
    out = F.when(F.contains(x, F.lit("@")), F.lit("email"))
    for kind, form in forms.items():
        out = out.when(F.regexp(x, F.lit(form)), F.lit(kind))
    return out.otherwise(F.lit("name"))


def honorific(raw: Column) -> Column:
    return F.regexp_extract(raw, f"^{HONORIFIC} ", 0)


def words_of(raw: Column) -> Column:
    """The words of a name without its honorific."""
    return F.split(F.substring(raw, F.length(honorific(raw)) + 1, F.length(raw)), " ")


def mentions(text: Column, pattern: Column) -> Column:
    """array of (kind, raw, parts): parts are the canonical entities of a mention, each word of a name and the domain of a mail apart."""

    def one(raw: Column) -> Column:
        kind = _kind(raw)
        own = F.regexp_replace(raw, CODE, "")
        parts = F.when(kind == "name", F.transform(words_of(raw), F.lower)).when(kind == "email", F.array(F.lower(raw), F.lower(F.split_part(raw, F.lit("@"), F.lit(2)))))
        parts = parts.when(kind == "ip", F.array(F.concat_ws(".", F.transform(F.split(raw, "[.]"), lambda o: o.cast("int").cast("string"))))).when(kind == "ipv6", F.array(F.lower(raw)))
        parts = parts.when(kind == "iban", F.array(F.replace(raw, F.lit(" ")))).when(kind == "phone", F.array(F.regexp_replace(own, "[^0-9]", ""))).otherwise(F.array(F.regexp_replace(raw, "[^0-9]", "")))
        return F.struct(kind.alias("kind"), raw.alias("raw"), parts.alias("parts"))

    return F.transform(F.regexp_extract_all(text, pattern, F.lit(0)), one)


def _shaped(kind: Column, raw: Column, parts: Column) -> Column:
    """A mention with its surrogates in the mention's format."""
    code = F.when(kind == "phone", F.regexp_extract(raw, CODE, 0)).otherwise("")
    rest = F.substring(raw, F.length(code) + 1, F.length(raw))

    def step(state: Column, c: Column) -> Column:
        filled = F.regexp(c, F.when(kind == "iban", "^[0-9A-Z]$").otherwise("^[0-9]$"))
        return F.struct(F.concat(state["out"], F.when(filled, F.substring(parts[0], state["i"], F.lit(1))).otherwise(c)).alias("out"), (state["i"] + F.when(filled, 1).otherwise(0)).alias("i"))

    number = F.concat(code, F.aggregate(F.split(rest, ""), F.struct(F.lit("").alias("out"), F.lit(1).alias("i")), step)["out"])
    words = words_of(raw)
    cased = F.transform(parts, lambda p, i: F.when((F.length(F.element_at(words, i + 1)) > 1) & (F.upper(F.element_at(words, i + 1)) == F.element_at(words, i + 1)), F.upper(p)).otherwise(F.initcap(p)))
    name = F.concat(honorific(raw), F.array_join(cased, " "))
    return F.when(kind == "name", name).when(kind == "email", F.concat_ws("@", parts[0], parts[1])).when(kind.isin("ip", "ipv6"), parts[0]).otherwise(number)


def _few(df: DataFrame) -> DataFrame:
    """``df`` to be broadcast if it is small."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def bare_names(rows: DataFrame, raws: DataFrame) -> DataFrame:
    """(blob, size, pattern): what matches the known names without honorific in the texts of ``rows``; ``raws`` has the names with one."""
    names = written(raws.select("blob", words_of(F.col("raw")).alias("words")), "names")
    last = F.element_at("words", -1)
    given = _few(written(names.select(F.explode(F.when(F.size("words") > 1, F.slice("words", 1, F.size("words") - 1)).otherwise(F.col("words"))).alias("w")).select(F.lower("w").alias("given")).distinct(), "given"))
    family = _few(written(names.select(F.lower(last).alias("family")).distinct(), "family"))
    pair = F.arrays_zip(F.regexp_extract_all("text", F.lit(PAIR), F.lit(0)).alias("a"), F.regexp_extract_all("text", F.lit(PAIR), F.lit(1)).alias("b"))
    pairs = rows.select("blob", F.explode(F.array_distinct(pair)).alias("p")).select("blob", "p.a", "p.b", F.lower("p.a").alias("given"), F.lower("p.b").alias("family"))
    pairs = pairs.join(given, "given").join(family, "family").select("blob", F.concat_ws(" ", "a", "b").alias("name"))
    alone = names.select("blob", F.explode("words").alias("w")).where("length(w) > 2").select("blob", F.explode(F.array("w", F.initcap(F.lower("w")))).alias("name"))
    by = pairs.union(alone).groupBy("blob").agg(F.collect_set("name").alias("names"))
    longest_first = F.transform(F.sort_array(F.transform("names", lambda n: F.struct(-F.length(n), n.alias("n")))), lambda x: F.concat(F.lit("\\Q"), x["n"], F.lit("\\E")))
    return written(by.select("blob", F.concat(F.lit(r"(?<![\p{L}\p{N}'-])(?:"), F.array_join(longest_first, "|"), F.lit(r")(?![\p{L}\p{N}])")).alias("bare")), "bare")


def assign(entities: DataFrame, key: str) -> DataFrame:
    """(kind, canon, surrogate) for distinct (kind, canon, gender): no surrogate twice, none that is an entity."""
    entities = written(entities, "entities")
    pending, done = entities, None
    for attempt in range(ATTEMPTS):
        drawn = pending.withColumn("attempt", F.lit(attempt)).withColumn("surrogate", F.expr(surrogate(key))).drop("attempt")
        taken = entities.select("kind", F.when(F.col("kind") == "email", F.split_part("canon", F.lit("@"), F.lit(1))).otherwise(F.col("canon")).alias("surrogate"))
        if done is not None:
            taken = taken.union(done.select("kind", "surrogate"))
        free = drawn.join(taken.distinct(), ["kind", "surrogate"], "left_anti")
        chosen = written(free.groupBy("kind", "surrogate").agg(F.min("canon").alias("canon")).select("kind", "canon", "surrogate"), "chosen")
        done = chosen if done is None else done.union(chosen)
        pending = written(pending.join(chosen, ["kind", "canon"], "left_anti"), "pending")
        if pending.isEmpty():
            return done
    # so many numbers of a length are taken that free ones cannot be hit: permute all of that length, which keeps them distinct
    length = F.length("canon").alias("length")
    dense = written(pending.select("kind", length).distinct(), "dense")
    kept = done.withColumn("length", F.length("canon")).join(dense, ["kind", "length"], "left_anti").drop("length")
    drawn = entities.withColumn("length", F.length("canon")).join(dense, ["kind", "length"], "left_semi").drop("length")
    return kept.union(drawn.withColumn("attempt", F.lit(ATTEMPTS)).withColumn("surrogate", F.expr(surrogate(key))).select("kind", "canon", "surrogate"))


def pseudonymize(df: DataFrame, key: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, text with surrogates, n_entities, n_<kind>...) for every row."""
    rows = df.select(F.col(id_col).alias("id"), F.col(text).cast("string").alias("text"))
    hit = F.coalesce(F.regexp(F.col("text"), F.lit(TRIGGER)) & F.regexp(F.col("text"), F.lit(PATTERN)), F.lit(False))
    digest = F.sha2("text", 256)
    named = F.filter(F.regexp_extract_all("text", F.lit(PATTERN), F.lit(0)), lambda m: F.length(honorific(m)) > 0)
    raws = rows.where(F.regexp(F.col("text"), F.lit(f"{HONORIFIC} "))).select(digest.alias("blob"), F.explode(F.array_distinct(named)).alias("raw")).distinct()
    bare = bare_names(rows.where(F.regexp(F.col("text"), F.lit(PAIR))).select(digest.alias("blob"), "text"), raws)
    wanted = _few(bare.select("blob"))
    of_text = F.when(F.regexp(F.col("text"), F.lit(PAIR)) | hit, digest)  # texts with bare names have either
    marked = rows.withColumn("of_text", of_text).join(wanted, F.col("of_text") == F.col("blob"), "left").withColumn("hit", hit | F.col("blob").isNotNull())
    texts = marked.where("hit").select("id", "text", digest.alias("blob")).join(bare, "blob", "left")
    texts = written(texts.select("id", "text", "blob", F.concat_ws("|", F.lit(PATTERN), "bare").alias("pattern")), "texts")

    found = written(texts.select("blob", mentions(F.col("text"), F.col("pattern")).alias("found")).dropDuplicates(["blob"]), "mentions")
    places = found.select("blob", F.posexplode("found").alias("at", "m")).select("blob", "at", "m.kind", "m.raw", F.posexplode("m.parts").alias("part", "canon"), F.size("m.parts").alias("parts"))
    places = places.withColumn("part_kind", F.when((F.col("kind") == "email") & (F.col("part") == 1), "domain").otherwise(F.col("kind")))
    title = F.replace(F.trim(honorific(F.col("raw"))), F.lit("."))
    sex = F.when(title.isin(HONORIFICS["f"].split()), "f").when(title.isin(HONORIFICS["m"].split()), "m")
    is_given = (F.col("kind") == "name") & (F.col("part") < F.col("parts") - 1)
    entities = places.groupBy(F.col("part_kind").alias("kind"), "canon").agg(F.collect_set(F.when(is_given, sex)).alias("sexes"), F.max((F.col("kind") == "name") & (F.col("parts") > 1) & ~is_given).alias("family"))
    gender = F.when((F.size("sexes") == 1) & ~F.col("family"), F.col("sexes")[0])
    surrogates = assign(entities.select("kind", "canon", gender.alias("gender")), key).withColumnRenamed("kind", "part_kind")
    mapped = places.join(surrogates, ["part_kind", "canon"]).groupBy("blob", "at", "kind", "raw").agg(F.sort_array(F.collect_list(F.struct("part", "surrogate"))).alias("parts"))
    mapped = mapped.select("blob", "at", "kind", _shaped(F.col("kind"), F.col("raw"), F.transform("parts", lambda p: p["surrogate"])).alias("new"))
    mapped = mapped.groupBy("blob").agg(F.sort_array(F.collect_list(F.struct("at", "new", "kind"))).alias("news"))
    mapped = written(mapped, "mapped")  # both sides of the join with the texts are plain shuffles, so a text of very many copies can be split
    counts = [F.expr(f"cast(size(filter(news, m -> m.kind = '{kind}')) as bigint)").alias(f"n_{kind}") for kind, _ in KINDS]
    gaps = F.split(F.col("text"), F.col("pattern"), -1)
    rebuilt = F.array_join(F.transform(gaps, lambda g, i: F.concat(g, F.coalesce(F.try_element_at(F.col("news"), i + 1)["new"], F.lit("")))), "")
    changed = texts.join(mapped, "blob").select("id", rebuilt.alias("text"), F.size("news").cast("long").alias("n_entities"), *counts)
    same = marked.where("not hit").select("id", "text", *(F.lit(0).cast("long").alias(n) for n in ("n_entities", *(f"n_{kind}" for kind, _ in KINDS))))
    return changed.union(same).withColumnRenamed("id", id_col)
