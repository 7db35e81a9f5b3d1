"""Text analysis for retrieval: words, spelling folds, stop words, stems and one hop of related words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: letters, digits, underscore, the Arabic block and the straight apostrophe.
WORD = r"([\p{L}\p{N}_\x{0600}-\x{06FF}']+)"

# Words that rank nothing in a statute book, unless the corpus defines them.
STOPWORDS = """the a an of in to for by or and any such shall be is are as on with under this that it its act section sub clause
provided may which who where has have had been was were not no if than then whoever person persons commit commits committed punished
punishable liable what when how why can could does do did i me my we our you your they their his her him about there law legal""".split()

# Endings a stem may lose, leaving three letters or more.
SUFFIXES = "ations ation ements ement ments ment ingly ing edly ed ions ion ies ic ers er ors or es s y e".split()

# Statute words for everyday ones (also read backwards), and English variants.
STATUTE_WORDS = {
    "murder": "qatl amd", "homicide": "qatl", "manslaughter": "qatl khata", "killing": "qatl death", "duress": "ikrah", "compulsion": "ikrah", "theft": "chori",
    "robbery": "haraabah", "adultery": "zina", "retaliation": "qisas", "bloodmoney": "diyat", "discretionary": "tazir", "hurt": "jurh", "defamation": "qazf",
}
VARIANTS = {"sentence": "punishment", "punishment": "sentence", "penalty": "punishment sentence"}

# Groups of irregular forms.
IRREGULAR = [
    "pay pays paid paying payment payments payable payee payer",
    "give gives gave given giving",
    "hold holds held holding holder",
    "find finds found finding findings",
    "bind binds bound binding",
    "forbid forbids forbade forbidden forbidding",
    "strike strikes struck striking",
    "send sends sent sending",
    "lend lends lent lending",
    "spend spends spent spending",
    "bring brings brought bringing",
    "seek seeks sought seeking",
    "think thinks thought thinking",
    "catch catches caught catching",
    "swear swears swore sworn swearing",
    "steal steals stole stolen stealing theft thefts thief thieves",
    "break breaks broke broken breaking",
    "speak speaks spoke spoken speaking",
    "write writes wrote written writing writings",
    "know knows knew known knowing knowingly knowledge",
    "choose chooses chose chosen choosing",
    "bear bears bore borne bearing bearer",
    "lose loses lost losing loss losses",
    "meet meets met meeting",
    "sell sells sold selling sale sales seller",
    "tell tells told telling",
    "sit sits sat sitting",
    "stand stands stood standing",
    "deal deals dealt dealing",
    "keep keeps kept keeping keeper",
    "leave leaves left leaving",
    "arise arises arose arisen arising",
    "begin begins began begun beginning",
    "run runs ran running",
    "fall falls fell fallen falling",
    "rise rises rose risen rising",
    "drive drives drove driven driving driver",
    "hide hides hid hidden hiding",
    "shoot shoots shot shooting",
    "flee flees fled fleeing",
    "power powers empower empowers empowered empowering powered",
    "prove proves proved proven proving proof proofs",
    "die dies died dying death deaths dead",
    "live lives lived living life",
    "judge judges judged judging judgment judgments judicial",
    "believe believes believed believing belief beliefs",
    "relieve relieves relieved relieving relief",
    "marry marries married marrying marriage marriages",
    "child children",
    "person persons people",
    "wife wives",
    "woman women",
    "man men",
]

# Words that set one offence apart from another; a hit that misses one in the question is another offence.
QUALIFIERS = """attempt attempted abetment abet abetting conspiracy conspiring omission preparation threat threatening negligence negligent
accidental unintentional involuntary mitigated aggravated amd khata shibh qisas tazir diyat ikrah""".split()


def folded(word: Column) -> Column:
    """Apostrophes dropped; from seven letters on the -is-/-ys- spellings read -iz-/-yz-."""
    bare = F.replace(word, F.lit("'"), F.lit(""))
    bare = F.when(bare == "", word).otherwise(bare)
    return F.when(F.length(bare) >= 7, F.regexp_replace(bare, r"([iy])s(e|ed|es|ing|ation|ations)$", "$1z$2")).otherwise(bare)


def words(text: Column) -> Column:
    """All words of a text in order, folded; null gives an empty array."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD))
    return F.transform(found, folded)


def plain_words(text: str) -> list[str]:
    """The words of one text outside Spark, as `words` gives them."""
    import regex

    out = []
    for w in regex.findall(r"[\p{L}\p{N}_\u0600-\u06FF']+", text.lower()):
        bare = w.replace("'", "") or w
        out.append(regex.sub(r"([iy])s(e|ed|es|ing|ation|ations)$", r"\1z\2", bare) if len(bare) >= 7 else bare)
    return out


def without_stopwords(tokens: Column, defined: list[str] | None = None) -> Column:
    """Duplicates and order stay. Stop words the corpus defines stay too."""
    dropped = [w for w in STOPWORDS if w not in set(defined or ())]
    return F.filter(tokens, lambda w: ~w.isin(dropped))


def stems(term: Column) -> Column:
    """The term and every stem it may share with another form; other than ASCII letters has only itself."""
    fitting = F.filter(F.array(*[F.lit(x) for x in SUFFIXES]), lambda x: F.endswith(term, x) & (F.length(term) - F.length(x) >= 3))
    cut = F.transform(fitting, lambda x: F.substring(term, F.lit(1), F.length(term) - F.length(x)))
    twins = F.filter(cut, lambda x: F.substring(x, -1, 1) == F.substring(x, -2, 1))
    single = F.transform(twins, lambda x: F.substring(x, F.lit(1), F.length(x) - 1))
    return F.when(term.rlike("^[a-z]+$"), F.array_distinct(F.concat(F.array(term), cut, single))).otherwise(F.array(term))


def plain_stems(term: str) -> list[str]:
    """The stems of one term outside Spark."""
    if not (term.isascii() and term.isalpha() and term.islower()):
        return [term]
    cut = [term[: -len(x)] for x in SUFFIXES if term.endswith(x) and len(term) - len(x) >= 3]
    return list(dict.fromkeys([term, *cut, *(c[:-1] for c in cut if c[-1] == c[-2])]))


def related_words() -> list[tuple[str, str]]:
    """(word, related word) of all tables, both directions of the statute words."""
    pairs = [(w, r) for w, rs in STATUTE_WORDS.items() for r in rs.split()]
    pairs += [(r, w) for w, r in pairs] + [(w, r) for w, rs in VARIANTS.items() for r in rs.split()]
    for group in IRREGULAR:
        members = group.split()
        pairs += [(a, b) for a in members for b in members if a != b]
    return sorted(set(pairs))


def related_stems(spark: SparkSession) -> DataFrame:
    """(stem, other): the bridge from the stems of a listed word to those of its related words; a table of fixed size."""
    pairs = {(x, y) for word, related in related_words() for x in plain_stems(word) for y in plain_stems(related)}
    return spark.createDataFrame(sorted(pairs), "stem string, other string")


def expansion(terms: DataFrame, spark: SparkSession) -> DataFrame:
    """(term, stem): the stems of every term and of the words related to it, one hop and no further."""
    own = terms.select("term").distinct().select("term", F.explode(stems(F.col("term"))).alias("stem"))
    bridged = own.join(F.broadcast(related_stems(spark)), "stem").select("term", F.col("other").alias("stem"))
    return own.unionByName(bridged).distinct()
