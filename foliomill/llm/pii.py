"""PII: detected entities are replaced by surrogates, keyed and consistent over the whole corpus.

Detected are e-mail addresses, telephone numbers, card numbers, social security numbers, IP addresses, IBANs
and names after a title.  Each mention is reduced to its entity (digits of a number, lower-case address, single
name words), so all spellings of an entity in all documents get the same surrogate: coreference is kept.  A
surrogate is drawn from a keyed digest of the entity and has its type: a number keeps its length and its
punctuation, a name its script and the gender of the title, an address the shape of one; capitals stay capitals.

Draws are checked: one that equals another entity's surrogate, or a real entity of the corpus, is drawn again
with the next attempt until none is left (the smallest entity keeps a contested draw), so different entities
stay different and no surrogate is somebody's data.  Names grow a syllable with every attempt.  From attempt ``LENGTHEN``
on a number grows a digit with every attempt, so a length with more entities than free values is settled as well,
and an address takes its four numbers from 256 to 999, which are no address.  A telephone number has seven digits
or more.

Everything is column expressions and joins.  Texts are cut at the mentions by one regex; only the mentions
travel to the table of entities and back.

Defined cases: a null text stays null and an empty one empty; a text without mentions stays as it is; documents
are told apart by doc_id and a digest of the text, so null and repeated ids are fine and equal rows get equal
texts; other columns pass ``replace_rows`` unchanged, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliomill.llm import common

KEY = ["_id", "_mix"]
ATTEMPTS = 40
LENGTHEN = 8
# Titles that tell the gender.
MALE = "Mr|Herr|Monsieur|Señor|Sr|Г-н"
FEMALE = "Mrs|Ms|Miss|Frau|Madame|Mme|Señora|Sra|Г-жа"
# Seven digits behind the plus; Java wants the length of a look-behind written out.
_SEVEN = "(?<=" + r"[0-9][ .()-]{0,3}" * 6 + "[0-9])"
_NAME = r"\p{Lu}[\p{L}'’-]+"
# Kind and pattern; the first kind that fits a mention counts.  Runs are entered at their start only.
KINDS = (
    ("email", r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[\p{L}\p{N}-]+(?:\.[\p{L}\p{N}-]+)+"),
    ("iban", r"(?<![\p{L}\p{N}])[A-Z]{2}[0-9]{2}(?: ?[0-9A-Z]{4}){2,7}(?: ?[0-9A-Z]{1,3})?(?![\p{L}\p{N}])"),
    ("card", r"(?<![\p{L}\p{N}.-])(?:[0-9]{13,19}|[0-9]{4}([ -])[0-9]{4}\g[0-9]{4}\g[0-9]{1,7})(?![\p{L}\p{N}])"),
    ("ssn", r"(?<![\p{L}\p{N}.-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\p{L}\p{N}])"),
    ("ip", r"(?<![\p{L}\p{N}.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![\p{L}\p{N}])"),
    ("phone", r"(?<![\p{L}\p{N}+])(?:\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{1,4}(?:[ .-]?[0-9]{2,4}){1,4}" + _SEVEN + r"|\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}|[0-9]{3}([.-])[0-9]{3}\g[0-9]{4})(?![\p{L}\p{N}])"),
    ("name", rf"(?<!\p{{L}})(?:{MALE}|{FEMALE})\.? {_NAME}(?: {_NAME})?"),
)
GATE = rf"[0-9@]|(?:{MALE}|{FEMALE})\.? \p{{Lu}}"
_ONSETS = {"latin": "b c d f g h j k l m n p r s t v".split(), "cyrillic": "б в г д ж з к л м н п р с т ф х".split()}
_VOWELS = {"latin": "a e i o u".split(), "cyrillic": "а е и о у".split()}
_ENDINGS = {("male", "latin"): "n", ("female", "latin"): "na", ("surname", "latin"): "rd", ("male", "cyrillic"): "н", ("female", "cyrillic"): "на", ("surname", "cyrillic"): "рко"}


def _pattern() -> str:
    """All kinds as one alternation; ``\\g`` in a kind means its own first group."""
    found, groups = [], 0
    for _, rx in KINDS:
        own = rx.count("([")
        found.append(rx.replace(r"\g", f"\\{groups + 1}"))
        groups += own
    return "|".join(found)


PATTERN = _pattern()


def _kind(mention: Column) -> Column:
    fits = [(kind, mention.rlike("^(?:" + rx.replace(r"\g", r"\1") + ")$")) for kind, rx in KINDS]
    out = F.when(fits[0][1], fits[0][0])
    for kind, test in fits[1:]:
        out = out.when(test, kind)
    return out.otherwise("name")


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").alias("_id"), F.xxhash64(text).alias("_mix"), text.alias("_text"))


def mentions(docs: DataFrame) -> DataFrame:
    """One row per mention and document key: at (its number in the text), mention, kind."""
    found = F.when(F.col("_text").rlike(GATE), F.regexp_extract_all("_text", F.lit(PATTERN), F.lit(0)))
    rows = _keyed(docs).select(*KEY, F.posexplode(found).alias("at", "mention")).distinct()
    return rows.withColumn("kind", _kind(F.col("mention")))


def _parts(rows: DataFrame) -> DataFrame:
    """Mentions as parts: type, entity, raw.  Names have a part for each word, all others one."""
    m = F.col("mention")
    digits = F.regexp_replace(m, "[^0-9A-Za-z]", "")
    entity = F.when(F.col("kind") == "email", F.lower(m)).when(F.col("kind") == "ip", m).otherwise(digits)
    one = F.array(F.struct(F.lit(0).alias("part"), F.col("kind").alias("type"), entity.alias("entity"), m.alias("raw")))
    words = F.split(m, " ")
    script = F.when(m.rlike(r"\p{IsCyrillic}"), "cyrillic").otherwise("latin")
    gender = F.when(m.rlike(rf"^(?:{FEMALE})\.? "), "female").otherwise("male")
    # Of two words the first is the given name; a single word is a surname.
    role = F.when(F.size(words) > 2, gender).otherwise("surname")
    named = F.transform(
        F.slice(words, 2, F.size(words) - 1),
        lambda w, i: F.struct((i + 1).alias("part"), F.concat_ws(".", F.when(i == 0, role).otherwise("surname"), script).alias("type"), F.lower(w).alias("entity"), w.alias("raw")),
    )
    title = F.struct(F.lit(0).alias("part"), F.lit(None).cast("string").alias("type"), F.lit(None).cast("string").alias("entity"), F.element_at(words, 1).alias("raw"))
    both = F.when(F.col("kind") == "name", F.concat(F.array(title), named)).otherwise(one)
    return rows.select(*KEY, "at", F.explode(both).alias("p")).select(*KEY, "at", "p.*")


def _filled(raw: Column, digits: Column) -> Column:
    """``raw`` with its digits replaced, in order, by those of ``digits``."""
    chars = F.regexp_extract_all(raw, F.lit("(?s)."), F.lit(0))
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("k"))
    return F.aggregate(
        chars, start,
        lambda a, c: F.struct(F.concat(a["out"], F.when(c.rlike("[0-9]"), F.substr(digits, a["k"], F.lit(1))).otherwise(c)).alias("out"), (a["k"] + F.when(c.rlike("[0-9]"), 1).otherwise(0)).alias("k")),
        lambda a: a["out"],
    )


def _draw(key: str) -> tuple[Column, Column]:
    """For type, entity, attempt: the digest and the surrogate's plain form."""
    digest = F.sha2(F.concat_ws("|", F.lit(key), "type", "entity", F.col("attempt").cast("string")), 256)
    d = F.col("digest")

    def byte(k: int) -> Column:
        return F.conv(F.substring(d, 2 * k + 1, 2), 16, 10).cast("int")

    def pick(values: list[str], k: int) -> Column:
        return F.element_at(F.array(*map(F.lit, values)), (byte(k) % len(values)) + 1)

    domain = F.sha2(F.concat_ws("|", F.lit(key), F.lit("domain"), F.substring_index("entity", "@", -1)), 256)
    email = F.concat(F.lit("u"), F.substring(d, 1, 16), F.lit("@"), F.lit("d"), F.substring(domain, 1, 8), F.lit(".example"))
    def beyond(k: int) -> Column:
        return (F.conv(F.substring(d, 4 * k + 1, 4), 16, 10).cast("int") % 744 + 256).cast("string")

    ip = F.when(F.col("attempt") < LENGTHEN, F.concat_ws(".", F.lit("10"), *(byte(k).cast("string") for k in range(3)))).otherwise(F.concat_ws(".", *map(beyond, range(4))))
    out = F.when(F.col("type") == "email", email).when(F.col("type") == "ip", ip)
    for (role, script), ending in _ENDINGS.items():
        syllables = [F.concat(pick(_ONSETS[script], 2 * k), pick(_VOWELS[script], 2 * k + 1)) for k in range(12)]
        out = out.when(F.col("type") == f"{role}.{script}", F.concat(F.array_join(F.slice(F.array(*syllables), F.lit(1), F.least(F.col("attempt") + 3, F.lit(12))), ""), F.lit(ending)))
    n = F.char_length(F.regexp_replace("entity", "[^0-9]", ""))
    more = F.substr(_digits(), n + 1, F.greatest(F.col("attempt") - (LENGTHEN - 1), F.lit(0)))
    return digest, out.otherwise(F.concat(_filled(F.col("entity"), _digits()), more))


def _digits() -> Column:
    """64 digits of the digest: each 15 hexadecimal ones give the last 16 of their decimal form, all digits alike."""
    return F.concat(*(F.substring(F.lpad(F.conv(F.substring("digest", 15 * k + 1, 15), 16, 10), 19, "0"), 4, 16) for k in range(4)))


def surrogates(entities: DataFrame, key: str) -> DataFrame:
    """type, entity -> digest, plain: distinct draws, none of them an entity."""
    digest, plain = _draw(key)
    entities = common.staged(entities, "entities")
    real = entities.select("type", F.col("entity").alias("plain"))
    left, done = entities.withColumn("attempt", F.lit(0)), None
    for attempt in range(ATTEMPTS):
        drawn = left.withColumn("digest", digest).withColumn("plain", plain)
        free = drawn.join(real, ["type", "plain"], "left_anti")
        if done is not None:
            free = free.join(done.select("type", "plain"), ["type", "plain"], "left_anti")
        won = free.groupBy("type", "plain").agg(F.min(F.struct("entity", "digest")).alias("w")).select("type", "w.entity", "w.digest", "plain")
        done = common.staged(won if done is None else done.unionByName(won), f"surrogates-{attempt}")
        left = entities.join(done, ["type", "entity"], "left_anti").withColumn("attempt", F.lit(attempt + 1))
        if left.isEmpty():
            return done
    raise ValueError(f"no free surrogates after {ATTEMPTS} attempts")


def replacements(docs: DataFrame, key: str) -> DataFrame:
    """One row per document key with mentions: kinds, and the replacements in the order of the text."""
    found = common.staged(mentions(docs), "mentions")
    parts = _parts(found)
    known = surrogates(parts.where("entity IS NOT NULL").select("type", "entity").distinct(), key)
    joined = parts.join(known, ["type", "entity"], "left")
    new = F.when(F.col("entity").isNull(), F.col("raw")).when(F.col("type").isin("email", "ip"), F.col("plain")).when(F.col("type").contains("."), F.initcap("plain")).otherwise(F.concat(_filled(F.col("raw"), _digits()), F.substr("plain", F.char_length("entity") + 1)))
    # What was written in capitals stays so.
    new = F.when((F.upper("raw") == F.col("raw")) & (F.lower("raw") != F.col("raw")), F.upper(new)).otherwise(new)
    whole = joined.select(*KEY, "at", "part", new.alias("new")).repartition(*KEY).groupBy(*KEY, "at").agg(F.array_sort(F.collect_list(F.struct("part", "new"))).alias("p"))
    listed = whole.select(*KEY, "at", F.array_join("p.new", " ").alias("new")).groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("at", "new"))).alias("all"))
    kinds = found.groupBy(*KEY).agg(F.count("*").alias("n_entities"), F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("kinds"))
    listed = listed.select(F.col("_id").alias("_id2"), F.col("_mix").alias("_mix2"), F.col("all.new").alias("news"))
    return kinds.join(listed, F.col("_id").eqNullSafe(F.col("_id2")) & (F.col("_mix") == F.col("_mix2"))).drop("_id2", "_mix2")


def _rebuilt(text: Column, news: Column) -> Column:
    pieces = F.split(text, PATTERN, -1)
    return F.array_join(F.flatten(F.zip_with(pieces, news, lambda p, n: F.array(p, F.coalesce(n, F.lit(""))))), "")


def _joined(docs: DataFrame, key: str) -> tuple[DataFrame, Column]:
    news = common.staged(replacements(docs, key), "replacements")
    mix = F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit("")))
    n, kinds, new = (common.fresh(docs, name) for name in ("_n_", "_kinds_", "_news_"))
    both = docs.join(news.hint("merge"), docs["doc_id"].eqNullSafe(news["_id"]) & (mix == news["_mix"]), "left")
    return both.select(*(docs[c] for c in docs.columns), news["n_entities"].alias(n), news["kinds"].alias(kinds), news["news"].alias(new)), F.when(F.col(new).isNotNull(), _rebuilt(docs["text"], F.col(new))).otherwise(docs["text"])


def replace(docs: DataFrame, key: str) -> DataFrame:
    """One row per document: doc_id, n_entities, kinds, text."""
    both, text = _joined(docs.select("doc_id", F.col("text").cast("string").alias("text")), key)
    return both.select("doc_id", F.coalesce("_n_", F.lit(0).cast("long")).alias("n_entities"), F.coalesce("_kinds_", F.lit("")).alias("kinds"), text.alias("text"))


def replace_rows(docs: DataFrame, key: str) -> DataFrame:
    """``docs`` with replaced texts; all other columns as they are."""
    both, text = _joined(docs, key)
    return both.select(*(text.alias("text") if c == "text" else docs[c] for c in docs.columns))


# The key of the registered query and of the pipeline; a user gives a secret of their own.
QUERY_KEY = "surrogates of the registered query"


def op8_pii(spark, sf_dir: str) -> DataFrame:
    return replace(common.documents(spark, sf_dir), QUERY_KEY)
