"""Surrogates for personal data, in DataFrame operations only.

Entities are e-mail addresses, phone numbers (international and national), IP
addresses, social security numbers, card numbers and IBANs that pass their check
sums (others are plain numbers and stay), and names behind a title, with the bare
mentions of their parts in the same text. A part's bare mention stays if it may
well be an ordinary word: if the text also has it in lower case, or if, over
all documents, the word (in any case) stands in at least COMMON times as many
texts as hold it in a name behind a title. The name behind the title is replaced
as a whole in any case. Every different entity of
the corpus gets one replacement, derived from a keyed hash of its kind and
value, so it reads the same wherever it occurs (a number whatever its
punctuation, a surname with or without a given name) and nothing of it can be
told without the key, which the caller has to give:

* numbers keep their length, punctuation and (while there is room) first digit,
  cards pass the check sum, IBANs theirs and keep the country, IP addresses stay valid;
* e-mail addresses keep the pattern of their local part, at a reserved domain;
* names keep title, particles, case and script (Latin, Cyrillic, Greek), given names the
  gender that the title tells.

A collision check over the distinct entities keeps replacements apart: one that
equals another entity's replacement, or a value that occurs in the corpus, is
drawn again with the next attempt, until none is left. Where a space of numbers
is crowded, later attempts may change the first digit and may draw a value that
occurs (as another entity's replacement); only a space that is all but full ends
in an error. Each attempt is a table in the shared folder; only those still
pending go on.

Texts without entities pass through without a shuffle; of the others only the
matches are joined with the replacements, and once per different text. Null
text stays null, empty text empty. Repeated rows are replaced alike; extra
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch

#: A later mention stays if its word is in so many times the texts that have it in a name behind a title.
COMMON = 20
#: Attempts after which the first digit may change, values that occur may be drawn, and drawing ends.
ANY_DIGIT, ANY_VALUE, MOST_ATTEMPTS = 8, 20, 200

#: Titles that show a gender, and those that don't.
FEMALE = ("Mrs", "Ms", "Miss", "Frau", "Señora", "Señorita", "Sra", "Srta", "Doña", "Madame", "Mme", "Mlle", "Signora",
          "Lady", "Dame", "Госпожа", "госпожа", "Г-жа", "г-жа", "Κυρία", "κυρία", "Κα", "κα")
MALE = ("Mr", "Herr", "Herrn", "Señor", "Sr", "Don", "Monsieur", "Signor", "Sir", "Lord", "Господин", "господин", "Г-н", "г-н",
        "Κύριος", "κύριος", "Κύριο", "κύριο", "Κος", "κος", "κ")
NEUTRAL = ("Mx", "Dr", "Dra", "Prof", "Professor", "Доктор", "доктор", "Профессор", "профессор", "Δρ", "Καθηγητής")
#: Small words inside a name; they stay.
PARTICLES = ("van", "von", "vom", "der", "den", "de", "del", "della", "di", "da", "dos", "das", "do", "du", "la", "le", "ten",
             "ter", "zu", "zum", "zur", "y", "bin", "ibn", "al", "el")

_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_TITLES = "|".join(sorted((*FEMALE, *MALE, *NEUTRAL), key=len, reverse=True))
_HEAD = rf"(?:(?:{_TITLES})\.? )+"
_PART = r"(?:\p{Lu}['’])?\p{Lu}[\p{L}\p{M}]+|\p{Lu}(?=\.)"
_SMALL = rf"(?:(?:{'|'.join(PARTICLES)})[ -]|[dl]['’])*"
_NAME = (rf"(?<![\p{{L}}\p{{N}}]){_HEAD}{_SMALL}(?:{_PART})"
         rf"(?:(?:[ -]|(?<=[^\p{{L}}]\p{{Lu}})\.[ -]?){_SMALL}(?:{_PART}))*(?![\p{{L}}\p{{M}}])")
_EMAIL = (r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]{1,64}+@[\p{L}\p{N}-]{1,63}+(?:\.[\p{L}\p{N}-]{1,63}+)+")
_IP = rf"(?<![\p{{L}}\p{{N}}])(?<![0-9]\.)(?:{_OCTET}\.){{3}}{_OCTET}(?![\p{{L}}\p{{N}}]|\.[0-9])"
_SSN = r"(?<![\p{L}\p{N}-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\p{L}\p{N}-])"
_PHONE = (r"(?<![\p{L}\p{N}+(])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)[ .-]?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![\p{L}\p{N}])"
          r"|(?<![\p{L}\p{N}+])\+[0-9]{1,3}(?:[ .-]?[0-9]{2,4}){2,4}(?![\p{L}\p{N}])"
          r"|(?<![\p{L}\p{N}+.,-])0[1-9](?:(?:[ .-][0-9]{2}){4}|[0-9]{0,3}[ /-][0-9]{5,8})(?![\p{L}\p{N}]|[.,-][0-9])")
_CARD = (r"(?<![\p{L}\p{N}])[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{4}(?![\p{L}\p{N}])"
         r"|(?<![\p{L}\p{N}+])[0-9]{13,19}(?![\p{L}\p{N}])")
_IBAN = (r"(?<![\p{L}\p{N}])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)(?![\p{L}\p{N}])")
ENTITY = "|".join((_EMAIL, _NAME, _IBAN, _IP, _SSN, _CARD, _PHONE))

_IBAN_SHAPE = "^[A-Z]{2}[0-9]{2}[ A-Z0-9]+$"

#: Letters of names that are made up; consonants and vowels of each script.
_SYLLABLES = {"latin": ("bdfgklmnprst", "aeiou"), "cyrillic": ("бдвгклмнпрст", "аеиоу"), "greek": ("βδφγκλμνπρστ", "αειου")}


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _byte(h: Column, i: Column | int) -> Column:
    """The i-th byte (from 0, round again after 64) of a sha2-512 in hex."""
    at = (F.lit(i) if isinstance(i, int) else i) % 64 * 2 + 1
    return F.conv(F.substr(h, at.cast("int"), F.lit(2)), 16, 10).cast("int")


def _letter(alphabet: str, n: Column) -> Column:
    return F.substr(F.lit(alphabet), (n % len(alphabet) + 1).cast("int"), F.lit(1))


def _like(value: Column, h: Column, keep: int = 0) -> Column:
    """A string with the pattern of ``value``: digits for digits, letters for letters; the first ``keep`` stay."""
    def one(i: Column) -> Column:
        c = F.substr(value, i.cast("int"), F.lit(1))
        new = (F.when(c.rlike("[0-9]"), _letter("0123456789", _byte(h, i)))
               .when(c.rlike(r"\p{Lu}"), _letter("ABCDEFGHIJKLMNOPQRSTUVWXYZ", _byte(h, i)))
               .when(c.rlike(r"\p{L}"), _letter("abcdefghijklmnopqrstuvwxyz", _byte(h, i))).otherwise(c))
        return F.when(i <= keep, c).otherwise(new)

    return F.array_join(F.transform(F.sequence(F.lit(1), F.length(value)), one), "")


def _check_sum(digits: Column) -> Column:
    """Luhn sum modulo 10 of a string of digits."""
    back = F.reverse(digits)
    terms = F.transform(F.sequence(F.lit(1), F.length(digits)), lambda i: F.when(
        i % 2 == 1, F.substr(back, i.cast("int"), F.lit(1)).cast("int")).otherwise(
        (F.substr(back, i.cast("int"), F.lit(1)).cast("int") * 2) % 10
        + F.floor(F.substr(back, i.cast("int"), F.lit(1)).cast("int") / 5).cast("int")))
    return F.aggregate(terms, F.lit(0), lambda a, x: a + x) % 10


def _card(value: Column, h: Column) -> Column:
    made = _like(value, h, 1)
    head = F.substr(made, F.lit(1), F.length(made) - 1)
    return F.concat(head, ((10 - _check_sum(F.concat(head, F.lit("0")))) % 10).cast("string"))


def _mod97(account: Column, head: Column) -> Column:
    """An IBAN's number modulo 97: the account and then country and check digits, letters as 10 to 35."""
    return F.aggregate(F.filter(F.split(F.concat(account, head), ""), lambda c: c != ""), F.lit(0), lambda a, c: F.when(
        c.rlike("[0-9]"), a * 10 + c.cast("int")).otherwise(a * 100 + F.ascii(c) - 55) % 97)


def _valid_iban(value: Column) -> Column:
    return _mod97(F.substr(value, F.lit(5)), F.substr(value, F.lit(1), F.lit(4))) == 1


def _iban(value: Column, h: Column) -> Column:
    country, account = F.substr(value, F.lit(1), F.lit(2)), _like(F.substr(value, F.lit(5)), h)
    check = (98 - _mod97(account, F.concat(country, F.lit("00")))).cast("string")
    return F.concat(country, F.lpad(check, 2, "0"), account)


def _name(h: Column, script: str, syllables: Column, ending: str) -> Column:
    consonants, vowels = _SYLLABLES[script]
    made = F.array_join(F.transform(F.sequence(F.lit(1), syllables), lambda i: F.concat(
        _letter(consonants, _byte(h, 2 * i)), _letter(vowels, _byte(h, 2 * i + 1)))), "")
    return F.initcap(F.concat(made, F.lit(ending)))


def surrogate(kind: Column, value: Column, attempt: Column, key: str) -> Column:
    """The replacement of an entity (kind, canonical value) at an attempt."""
    h = F.sha2(F.concat_ws("\u0001", F.lit(key), kind, value, attempt.cast("string")), 512)
    longer = F.floor(attempt / 2).cast("int")
    local = F.substring_index(value, "@", 1)
    # a space that is used up gets more room: letters behind the local part
    room = F.when(attempt > 3, _like(F.repeat(F.lit("x"), longer), F.sha2(h, 512))).otherwise("")
    domain = F.element_at(F.array(*map(F.lit, ("example.com", "example.net", "example.org"))), (_byte(h, 63) % 3 + 1))
    out = (F.when(kind == "email", F.concat(_like(local, h), room, F.lit("@"), domain))
           .when(kind == "ip", F.concat_ws(".", (_byte(h, 0) % 223 + 1).cast("string"), _byte(h, 1).cast("string"),
                                           _byte(h, 2).cast("string"), (_byte(h, 3) % 254 + 1).cast("string")))
           .when(kind == "card", _card(value, h))
           .when(kind == "iban", _iban(value, h))
           .when(kind.isin("phone", "ssn"), F.when(attempt < ANY_DIGIT, _like(value, h, 1)).otherwise(_like(value, h))))
    for script, (_, vowels) in _SYLLABLES.items():
        for part, syllables, ending in (("surname", 3, {"latin": "n", "cyrillic": "н", "greek": "ν"}[script]),
                                        ("female", 2, vowels[0]), ("male", 2, vowels[3]), ("neutral", 2, vowels[4])):
            out = out.when(kind == f"{part}_{script}",
                           _name(h, script, longer + syllables - int(part != "surname"), _last(script, part, ending)))
    return out


def _last(script: str, part: str, ending: str) -> str:
    return ending if part == "surname" else _SYLLABLES[script][0][6] + ending


def may_hold(text: Column) -> Column:
    """A cheap condition that every text with an entity meets: an at sign, a digit, or a title."""
    out = text.rlike("[@0-9]")
    titles = (*FEMALE, *MALE, *NEUTRAL)
    for title in titles:
        if not any(t != title and t in title for t in titles):          # a title that holds another needs no look
            out = out | text.contains(title)
    return out


def name_words(match: Column) -> Column:
    """The parts of a name behind its titles, in their order."""
    return F.regexp_extract_all(F.regexp_replace(match, f"^{_HEAD}", ""), F.lit(_PART), F.lit(0))


def parts(match: Column) -> Column:
    """The entities in a match: an array of (kind, canonical value); a name has one a part, in their order,
    a number that fails its check sum none.
    A bare mention comes as its kind and word, a \\u0001 before each."""
    name, words = F.regexp_replace(match, f"^{_HEAD}", ""), name_words(match)
    script = (F.when(name.rlike(r"\p{IsCyrillic}"), "cyrillic").when(name.rlike(r"\p{IsGreek}"), "greek")
              .otherwise("latin"))
    title = F.regexp_extract(match, f"^{_HEAD}", 0)
    shows = lambda titles: title.rlike(rf"(?:^| )(?:{'|'.join(titles)})\.? ")
    gender = F.when(shows(FEMALE), "female").when(shows(MALE), "male").otherwise("neutral")
    one = lambda kind, value: F.struct(kind.alias("kind"), value.alias("value"))
    names = F.transform(words, lambda w, i: one(
        F.concat(F.when(i == F.size(words) - 1, "surname").otherwise(gender), F.lit("_"), script), F.lower(w)))
    bare = F.split(match, "\u0001")
    digits, plain = _digits(match), F.regexp_replace(match, " ", "")
    kind = (F.when(match.rlike(r"^[0-9]{1,3}(?:\.[0-9]{1,3}){3}$"), "ip")
            .when(match.rlike(r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), "ssn")
            .when(match.rlike(r"^(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){3})$"), "card").otherwise("phone"))
    return (F.when(match.startswith("\u0001"), F.array(one(F.get(bare, F.lit(1)), F.lower(F.get(bare, F.lit(2))))))
            .when(match.contains("@"), F.array(one(F.lit("email"), F.lower(match))))
            .when(title != "", names)
            .when(match.rlike(_IBAN_SHAPE), F.filter(F.array(one(F.lit("iban"), plain)), lambda e: _valid_iban(e["value"])))
            .otherwise(F.filter(F.array(one(kind, F.when(kind == "ip", match).otherwise(digits))),
                                lambda e: (e["kind"] != "card") | (_check_sum(e["value"]) == 0))))


def fill(match: Column, new: Column) -> Column:
    """The match with its parts' replacements ``new`` (an array) in its own format."""
    head = F.regexp_extract(match, f"^{_HEAD}", 0)
    gaps = F.split(F.regexp_replace(match, f"^{_HEAD}", ""), _PART, -1)
    # an initial stays one letter
    shown = F.zip_with(name_words(match), new, lambda w, x: F.when(F.length(w) == 1, F.substr(x, F.lit(1), F.lit(1))).otherwise(x))
    name = F.concat(head, F.array_join(F.flatten(F.zip_with(F.slice(gaps, 1, F.size(new)), shown, lambda g, x: F.array(g, x))), ""),
                    F.element_at(gaps, -1))
    number = F.array_join(F.transform(F.sequence(F.lit(1), F.length(match)), lambda i: F.when(
        F.substr(match, i.cast("int"), F.lit(1)).rlike("[0-9]"),
        F.substr(new[0], F.length(_digits(F.substr(match, F.lit(1), i.cast("int")))), F.lit(1)))
        .otherwise(F.substr(match, i.cast("int"), F.lit(1)))), "")
    account = F.array_join(F.transform(F.sequence(F.lit(1), F.length(match)), lambda i: F.when(
        F.substr(match, i.cast("int"), F.lit(1)) == " ", " ").otherwise(
        F.substr(new[0], F.length(F.regexp_replace(F.substr(match, F.lit(1), i.cast("int")), " ", "")), F.lit(1)))), "")
    whole = match.contains("@") | match.startswith("\u0001") | match.rlike(r"^[0-9]{1,3}(?:\.[0-9]{1,3}){3}$")
    return F.when(whole, new[0]).when(head != "", name).when(match.rlike(_IBAN_SHAPE), account).otherwise(number)


def mentions(text: Column) -> Column:
    """The parts of names behind a title in a text: an array of (word, kind), initials left out."""
    of = lambda n: F.zip_with(name_words(n), parts(n), lambda w, p: F.struct(w.alias("word"), p["kind"].alias("kind")))
    every = F.flatten(F.transform(F.regexp_extract_all(text, F.lit(_NAME), F.lit(0)), of))
    return F.array_distinct(F.filter(every, lambda e: F.length(e["word"]) > 1))


def replacements(spark: SparkSession, entities: DataFrame, scratch: Scratch, key: str) -> DataFrame:
    """(kind, value, new) for distinct entities (kind, value): no two of a kind alike, and while there is room none
    a value that occurs; never its own."""
    pending = entities.withColumn("attempt", F.lit(0))
    done = scratch.write(entities.limit(0).withColumn("new", F.col("value")), "done0")
    for attempt in range(MOST_ATTEMPTS):
        drawn = scratch.write(
            pending.withColumn("new", surrogate(F.col("kind"), F.col("value"), F.lit(attempt), key))
            .withColumn("id", F.lower("new")), f"drawn{attempt}")
        first = drawn.where(F.col("id") != F.lower("value")).groupBy("kind", "id").agg(F.min("value").alias("value"))      # one of those that drew the same
        taken = done.select("kind", F.lower("new").alias("id"))
        if attempt < ANY_VALUE:
            taken = taken.unionByName(entities.select("kind", F.lower("value").alias("id")))
        good = (drawn.where(F.col("id") != F.lower("value")).join(first, ["kind", "id", "value"]).join(taken, ["kind", "id"], "left_anti")
                .select("kind", "value", "new"))
        good = scratch.write(good, f"good{attempt}")
        done = done.unionByName(good)
        pending = scratch.write(drawn.join(good, ["kind", "value"], "left_anti").select("kind", "value"),
                                f"pending{attempt}")
        if not pending.head(1):
            return done
    raise RuntimeError(f"replacements still collide after {MOST_ATTEMPTS} attempts: a space of numbers is full")


def later_mentions(rows: DataFrame, ids: list[Column], has: Column, scratch: Scratch) -> DataFrame:
    """(k1, k2, known) for texts with names behind titles: the parts (word, kind) whose bare mentions are replaced."""
    lower_case = lambda e: F.regexp_like("text", F.concat(
        F.lit(r"(?<![\p{L}\p{N}])"), F.lower(e["word"]), F.lit(r"(?![\p{L}\p{M}\p{N}])")))
    named = scratch.write(
        rows.where(has).select(*ids, "text", mentions(F.col("text")).alias("known")).where(F.size("known") > 0)
        .withColumn("known", F.filter("known", lambda e: ~lower_case(e)))
        .groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("n"), F.first("known").alias("known")), "named")
    parts_ = named.select("k1", "k2", "n", F.posexplode("known").alias("at", "e")).withColumn("word", F.lower("e.word"))
    if not parts_.head(1):
        return named.select("k1", "k2", "known")
    in_names = parts_.select("k1", "k2", "n", "word").distinct().groupBy("word").agg(F.sum("n").alias("titled"))
    words = F.array_distinct(F.split(F.lower("text"), r"[^\p{L}\p{M}'’]+"))
    used = rows.select(F.explode(words).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    common = scratch.write(in_names.join(used, "word").where(F.col("n") >= COMMON * F.col("titled")).select("word"), "common")
    return scratch.write(
        parts_.join(common, "word", "left_anti").groupBy("k1", "k2")
        .agg(F.sort_array(F.collect_list(F.struct("at", "e"))).alias("known")).select("k1", "k2", F.col("known.e").alias("known")),
        "later")


def replace(spark: SparkSession, docs: DataFrame, *, key: str) -> DataFrame:
    """doc_id, text with every entity replaced, and n_entities, for every row of ``docs`` (doc_id, text).

    ``key`` is the caller's secret: with it the replacements of a short number space could be tried out.
    """
    if not key:
        raise ValueError("replacements need a key")
    scratch = Scratch(spark, "pii")
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    has = F.coalesce(may_hold(F.col("text")) & F.col("text").rlike(ENTITY), F.lit(False))
    ids = [F.xxhash64("text").alias("k1"), F.xxhash64(F.lit(1), F.col("text")).alias("k2")]
    later = later_mentions(rows, ids, has, scratch)
    named = (rows.where(has).select(*ids, "text").dropDuplicates(["k1", "k2"]).join(later, ["k1", "k2"], "left")
             .withColumn("known", F.coalesce("known", F.array().cast(later.schema["known"].dataType)))
             .withColumn("pattern", F.when(F.size("known") == 0, ENTITY).otherwise(F.concat(
                 F.lit(ENTITY + r"|(?<![\p{L}\p{N}])(?:"), F.array_join(F.col("known.word"), "|"),
                 F.lit(r")(?![\p{L}\p{M}\p{N}])")))))
    bare = lambda m, known: F.get(F.filter(known, lambda e: e["word"] == m), F.lit(0))["kind"]
    found = scratch.write(named.select("k1", "k2", "pattern", F.transform(
        F.regexp_extract_all("text", F.col("pattern"), F.lit(0)), lambda m: F.coalesce(
            F.concat(F.lit("\u0001"), bare(m, F.col("known")), F.lit("\u0001"), m), m)).alias("m")), "found")
    matches = scratch.write(found.select(F.explode("m").alias("match")).distinct()
                            .withColumn("parts", parts(F.col("match"))), "matches")
    entities = scratch.write(matches.select(F.explode("parts").alias("p")).select("p.kind", "p.value").distinct(),
                             "entities")
    new = replacements(spark, entities, scratch, key)
    filled = (matches.select("match", F.posexplode("parts").alias("nth", "p"))
              .select("match", "nth", "p.kind", "p.value").join(new, ["kind", "value"])
              .groupBy("match").agg(F.sort_array(F.collect_list(F.struct("nth", "new"))).alias("new"))
              .select("match", fill(F.col("match"), F.col("new.new")).alias("fill"), F.lit(1).alias("entity")))
    stays = matches.where(F.size("parts") == 0).select("match", F.col("match").alias("fill"), F.lit(0).alias("entity"))
    filled = scratch.write(filled.unionByName(stays), "filled")
    fills = (found.select("k1", "k2", "pattern", F.posexplode("m").alias("at", "match")).join(filled, "match")
             .groupBy("k1", "k2", "pattern").agg(F.sort_array(F.collect_list(F.struct("at", "fill"))).alias("f"), F.sum("entity").alias("n_entities"))
             .select("k1", "k2", "pattern", F.col("f.fill").alias("fills"), "n_entities"))
    fills = scratch.write(fills, "fills")
    gaps = F.split("text", F.col("pattern"), -1)
    woven = F.concat(F.array_join(F.flatten(F.zip_with(F.slice(gaps, 1, F.size("fills")), F.col("fills"),
                                                       lambda g, f: F.array(g, f))), ""), F.element_at(gaps, -1))
    changed = (rows.where(has).select("*", *ids).join(fills, ["k1", "k2"])
               .select("doc_id", woven.alias("text"), "n_entities"))
    same = rows.where(~has).select("doc_id", "text", F.lit(0).cast("bigint").alias("n_entities"))
    return same.unionByName(changed)
