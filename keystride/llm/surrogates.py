"""Personal data replaced by keyed surrogates of the same type and format.

Entities: e-mail addresses, telephone and card numbers, IPv4 addresses, long hexadecimal secrets,
and names after a title. An entity's surrogate is made from a keyed hash of its type and canonical
form, so every mention gets the same one (coreference). Telephone and card numbers are their digits
alone, laid back into each mention's separators; the country code, which the digits tell, stays. A
name is its family name and, before it, its given name, each an entity of its own: the title stays
and plays no part, but for the gender of the given name. After a title without gender it has the
gender found elsewhere for this given name. Where a document has a name, its bare repetitions are
mentions too. An address keeps four parts of 0-255, a name its script, and a
mention all in capitals gets the surrogate in capitals. Surrogates of one type must differ from
each other and from every entity found in the corpus: of several that collide, the least entity
keeps its surrogate and the others draw again until nothing collides. After every GROW draws an
entity's surrogates are a digit or syllable longer (an IPv4 address becomes IPv6 after 8 x GROW), so a
format of which all or nearly all is taken does not end the query. The entity table grows with
the data and is joined, never broadcast unchecked.

Null text is empty. Repeated rows are treated alike. An empty table gives an empty result; other
columns play no part.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keystride.llm.common import quoted, row_key, small, stored, text_or_empty
from keystride.session import materialise

KEY = "keystride"
GROW = 8  # draws
LEAST_DIGITS = 7  # of a telephone number
TITLE = r"(?:(?:Mr|Mrs|Ms|Miss|Herr|Frau|Monsieur|Madame|Mme|Señor|Señora|Sra|г-н|г-жа|Dr|Dra|Prof|Professor|д-р|проф)\.? )+"
FEMALE = r"^(?:\S+ )*?(?:Mrs|Ms|Miss|Frau|Madame|Mme|Señora|Sra|Dra|г-жа)\.? "
MALE = r"^(?:\S+ )*?(?:Mr|Herr|Monsieur|Señor|г-н)\.? "
#: A word that can be the bare repetition of a name.
WORD = r"(?<![\p{L}\p{N}])\p{Lu}\p{Ll}+(?![\p{L}\p{N}])"
#: In this order: what an earlier pattern can match is no match of a later one.
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]{1,64}+@(?:[\p{L}\p{N}-]{1,63}\.){1,8}\p{L}{2,63}",
    "secret": r"(?<![0-9A-Za-z])(?:[0-9a-f]{32,64}|[0-9A-F]{32,64})(?![0-9A-Za-z])",
    "ip": r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\d|\.\d)",
    "card": r"(?<!\d)(?:\d{13,19}|\d{4}([ -])\d{4}\1\d{4}\1\d{4})(?!\d)",
    "phone": r"(?<![\d+])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{2,4}){1,4}(?!\d)|(?<![\d(])\(\d{3}\) ?\d{3}[ -]\d{4}(?!\d)|(?<!\d)\d{3}-\d{3}-\d{4}(?!\d)",
    "name": r"\b" + TITLE + r"\p{Lu}\p{Ll}+(?: \p{Lu}\p{Ll}+)?",
}
#: Country codes; none begins another one.
CODE = r"^(\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3}))"
ANY = "|".join(PATTERNS.values())
#: Made-up given names by script and gender.
GIVEN = {
    ("latin", "f"): ["Alba", "Berit", "Carla", "Dora", "Elin", "Flora", "Greta", "Hanna"],
    ("latin", "m"): ["Anton", "Boris", "Carlo", "David", "Emil", "Felix", "Georg", "Hugo"],
    ("cyrillic", "f"): ["Анна", "Вера", "Дарья", "Ирина"],
    ("cyrillic", "m"): ["Антон", "Борис", "Виктор", "Денис"],
}
SYLLABLES = {
    "latin": ["ba", "de", "fi", "go", "ka", "le", "mi", "no", "pa", "re", "si", "to", "va", "we", "zi", "lu"],
    "cyrillic": ["ба", "де", "фи", "го", "ка", "ле", "ми", "но", "па", "ре", "си", "то", "ва", "ве", "зи", "лу"],
}


def mentions(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(ANY), F.lit(0))


def kind(mention: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, pattern in reversed(PATTERNS.items()):
        out = F.when(mention.rlike(f"^(?:{pattern})$"), name).otherwise(out)
    return out


def entities(mention: Column, type_: Column) -> Column:
    """type, form and gender (null but of given names) of what a mention names: one form for all
    mentions of an entity."""
    name = F.split(F.regexp_replace(mention, f"^{TITLE}", ""), " ")
    gender = F.when(mention.rlike(FEMALE), "f").when(mention.rlike(MALE), "m")
    none = F.lit(None).cast("string")

    def one(t: Column, form: Column, of: Column = none) -> Column:
        return F.struct(t.alias("type"), form.alias("form"), of.alias("gender"))

    family = one(F.lit("family"), F.element_at(name, -1))
    given = one(F.lit("given"), F.element_at(name, 1), gender)
    plain = F.when(type_.isin("phone", "card"), F.regexp_replace(mention, r"[^\d+]", "")).otherwise(F.lower(mention))
    return F.when(type_ != "name", F.array(one(type_, plain))).when(F.size(name) > 1, F.array(family, given)).otherwise(F.array(family))


def laid(mention: Column, digits: Column) -> Column:
    """`mention` with the digits of `digits` in the places of its own."""
    digits = F.regexp_replace(digits, r"\D", "")
    upto = lambda n: F.length(F.regexp_replace(mention.substr(F.lit(1), n), r"\D", ""))
    one = lambda c, i: F.when(c.rlike(r"^\d$"), digits.substr(upto(i + 1), F.lit(1))).otherwise(c)
    return F.concat(F.array_join(F.transform(F.split(mention, "(?!^)"), one), ""), digits.substr(upto(F.length(mention)) + 1, F.length(digits)))


def _draw(type_: Column, form: Column, attempt: Column) -> Column:
    """64 hexadecimal digits that depend on the key, the entity and the attempt."""
    return F.sha2(F.concat_ws("\x1f", F.lit(KEY), type_, form, attempt.cast("string")), 256)


def _hex(digits: Column, at: int, n: int) -> Column:
    return F.conv(F.substring(digits, at, n), 16, 10).cast("long")


def _redrawn(form: Column, digits: Column, alphabet: str, pattern: str) -> Column:
    """`form` with each character that fits `pattern` replaced by one drawn from `alphabet`."""
    chars = F.split(form, "(?!^)")
    letters = F.lit(list(alphabet))

    def one(c: Column, i: Column) -> Column:
        value = F.conv(digits.substr((i * 2) % 62 + F.lit(1), F.lit(2)), 16, 10).cast("int")
        return F.when(c.rlike(pattern), F.element_at(letters, (value + i * (value % 7)) % len(alphabet) + 1)).otherwise(c)

    return F.array_join(F.transform(chars, one), "")


def surrogate(type_: Column, form: Column, attempt: Column) -> Column:
    d = _draw(type_, form, attempt)
    user = F.regexp_extract(form, "^([^@]+)@", 1)
    email = F.concat(_redrawn(user, d, "abcdefghijklmnopqrstuvwxyz", r"^\p{L}$"),
                     F.lit("."), (_hex(d, 1, 8) % 1_000_000).cast("string"), F.lit("@mail.example.invalid"))
    grown = F.floor(attempt / GROW).cast("int")
    # Grown surrogates end in hexadecimal digits made decimal.
    more = F.translate(d.substr(F.lit(33), grown), "abcdef", "012345")
    email = F.when(grown == 0, email).otherwise(F.concat(F.substring(d, 1, 24), F.lit("."), email))
    ip = F.array_join(F.transform(F.array(*[F.lit(i) for i in (1, 3, 5, 7)]), lambda i: F.conv(d.substr(i, F.lit(2)), 16, 10)), ".")
    six = F.concat(F.lit("2001:db8"), *[F.concat(F.lit(":"), d.substr(F.lit(i), F.lit(4))) for i in range(9, 33, 4)])
    ip = F.when(grown < 8, ip).otherwise(six)
    digits = F.concat(_redrawn(form, d, "0123456789", r"^\d$"), more)
    # The country code of a telephone number stays.
    code = F.regexp_extract(form, CODE, 1)
    phone = F.concat(code, _redrawn(F.regexp_replace(form, CODE, ""), d, "0123456789", r"^\d$"), more)
    secret = F.substring(d, F.lit(1), F.length(form).cast("int"))

    def syllables(script: str, wanted: Column, most: int) -> Column:
        parts = F.lit(SYLLABLES[script])
        some = [F.element_at(parts, (_hex(d, 9 + 2 * i, 2) % 16 + 1).cast("int")) for i in range(most)]
        return F.concat(*[F.when(wanted > i, x).otherwise("") for i, x in enumerate(some)])

    def given(script: str) -> Column:
        first = [F.element_at(F.lit(GIVEN[script, g]), (_hex(d, 1, 4) % len(GIVEN[script, g]) + 1).cast("int")) for g in "fm"]
        return F.concat(F.when(type_ == "given f", first[0]).otherwise(first[1]), syllables(script, attempt, 12))

    cyrillic = form.rlike(r"\p{IsCyrillic}")
    family = F.when(cyrillic, syllables("cyrillic", 5 + grown, 12)).otherwise(syllables("latin", 5 + grown, 12))
    return (
        F.when(type_ == "email", email).when(type_ == "ip", ip).when(type_ == "card", digits)
        .when(type_ == "phone", phone).when(type_ == "secret", secret).when(type_ == "family", F.initcap(family))
        .when(cyrillic, given("cyrillic")).otherwise(given("latin"))
    )


def dictionary(entities: DataFrame) -> DataFrame:
    """type, form and surrogate of each entity (type, form); no two surrogates of a type agree,
    and none is an entity's form."""
    forms = materialise(entities.distinct().withColumn("attempt", F.lit(0)), "entities")
    forms = materialise(forms.withColumn("surrogate", surrogate(F.col("type"), F.col("form"), F.col("attempt"))), "drawn")
    real = forms.select("type", F.col("form").alias("surrogate"))
    while True:
        # Settled ones win over new draws, then the least form.
        owner = forms.groupBy("type", "surrogate").agg(F.min(F.struct("attempt", "form")).alias("owner"), F.count("*").alias("n"))
        clash = owner.where("n > 1").select("type", "surrogate", F.col("owner.form").alias("keeps"))
        clash = clash.join(real, ["type", "surrogate"], "left_anti").union(
            owner.join(real, ["type", "surrogate"], "left_semi").select("type", "surrogate", F.lit(None).cast("string"))
        )
        marked = forms.join(clash.withColumn("clash", F.lit(True)), ["type", "surrogate"], "left")
        again = F.coalesce("clash", F.lit(False)) & ~F.coalesce(F.col("form") == F.col("keeps"), F.lit(False))
        marked = materialise(marked.select("type", "form", "attempt", "surrogate", again.alias("again")), "drawn")
        if marked.where("again").isEmpty():
            return forms.select("type", "form", "surrogate")
        attempt = F.when(F.col("again"), F.col("attempt") + 1).otherwise(F.col("attempt"))
        forms = marked.withColumn("attempt", attempt).select(
            "type", "form", "attempt",
            F.when(F.col("again"), surrogate(F.col("type"), F.col("form"), F.col("attempt"))).otherwise(F.col("surrogate")).alias("surrogate"),
        )
        forms = materialise(forms, "drawn")


def replaced(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_entities (mentions), text with surrogates."""
    docs = stored(docs)
    rows = docs.select(row_key(docs).alias("row"), quoted(doc_id).alias("doc_id"), text_or_empty(text).alias("text"))
    found = rows.select("row", F.explode(F.array_distinct(mentions(F.col("text")))).alias("mention"))
    found = found.withColumn("kind", kind(F.col("mention")))
    # "+2500" is no telephone number.
    short = (F.col("kind") == "phone") & (F.length(F.regexp_replace("mention", r"\D", "")) < LEAST_DIGITS)
    found = found.where(~short)
    found = materialise(found.select("row", "mention", "kind", F.inline(entities(F.col("mention"), F.col("kind")))), "mentions")
    genders = materialise(found.where("gender is not null").groupBy("form").agg(F.max("gender").alias("elsewhere")), "genders")
    drawn = F.when(F.pmod(F.xxhash64("form"), F.lit(2)) == 0, "f").otherwise("m")
    gender = F.coalesce("gender", "elsewhere", drawn)
    found = found.join(small(genders), "form", "left").withColumn("type", F.when(F.col("type") == "given", F.concat(F.lit("given "), gender)).otherwise(F.col("type")))
    names = dictionary(found.select("type", "form"))
    said = materialise(found.join(names, ["type", "form"]).select("row", "mention", "kind", "type", "form", "surrogate"), "said")
    first = F.max(F.when(F.col("type").startswith("given"), F.col("surrogate")))
    main = F.max(F.when(~F.col("type").startswith("given"), F.col("surrogate")))
    whole = said.groupBy("row", "mention", "kind").agg(first.alias("first"), main.alias("main"))
    # A mention all in capitals gets capitals.
    loud = (F.col("mention") != F.lower("mention")) & (F.col("mention") == F.upper("mention"))
    name = F.concat(F.regexp_extract("mention", f"^({TITLE})", 1), F.concat_ws(" ", "first", "main"))
    say = (
        F.when(F.col("kind") == "name", name).when(F.col("kind").isin("phone", "card"), laid(F.col("mention"), F.col("main")))
        .when(loud, F.upper("main")).otherwise(F.col("main"))
    )
    # A word that is a family name and a given name of the document is the family name.
    bare = said.where("kind = 'name'").groupBy("row", F.col("form").alias("mention")).agg(F.min(F.struct("type", "surrogate"))["surrogate"].alias("say"))
    entries = whole.select("row", "mention", say.alias("say"), (F.col("kind") == "name").alias("named")).union(bare.select("*", F.lit(True)))
    # As many entries as the document has different mentions.
    maps = entries.groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("mention", "say"))).alias("say"), F.max("named").alias("named"))
    # Texts meet their replacements by a shuffle at every size: those grow with the documents.
    joined = rows.join(materialise(maps, "replacements").hint("merge"), "row", "left")
    has, wide = F.col("say").isNotNull(), f"{ANY}|{WORD}"
    all_of = lambda pattern: F.regexp_extract_all("text", F.lit(pattern), F.lit(0))
    inside = F.when(F.col("named"), all_of(wide)).when(has, all_of(ANY)).otherwise(F.array().cast("array<string>"))
    parts = joined.withColumn("inside", inside)
    # Words that are no name of the document stay.
    said = F.transform("inside", lambda m: F.coalesce(F.element_at("say", m), m))
    between = F.when(F.col("named"), F.split("text", wide, -1)).otherwise(F.split("text", ANY, -1))
    woven = F.array_join(F.flatten(F.zip_with(between, F.concat(said, F.array(F.lit(""))), lambda p, s: F.array(p, s))), "")
    count = F.when(has, F.size(F.filter("inside", lambda m: F.map_contains_key("say", m)))).otherwise(0)
    return parts.select("doc_id", count.cast("long").alias("n_entities"), F.when(has, woven).otherwise(F.col("text")).alias("text"))
