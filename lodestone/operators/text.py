"""Search, identifiers, routing and log templates."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

K1, B = 1.2, 0.75


def tokens(text: Column) -> Column:
    """Lower-case runs of ASCII letters and digits, two characters at least."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]{2,}"), F.lit(0))


def fts_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def stem_word(w: str) -> str:
    """Porter's suffix stripping."""
    if len(w) < 3 or not w.isascii():
        return w
    cons = lambda s, i: s[i] not in "aeiou" and not (s[i] == "y" and i > 0 and cons(s, i - 1))
    shape = lambda s: re.sub(r"(.)\1*", r"\1", "".join("c" if cons(s, i) else "v" for i in range(len(s))))
    m = lambda s: shape(s).count("vc")
    vowel = lambda s: "v" in shape(s)
    double = lambda s: len(s) > 1 and s[-1] == s[-2] and cons(s, len(s) - 1)
    cvc = lambda s: len(s) > 2 and cons(s, len(s) - 1) and not cons(s, len(s) - 2) and cons(s, len(s) - 3) and s[-1] not in "wxy"
    for end, to in (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")):
        if w.endswith(end):
            w = w[: len(w) - len(end)] + to
            break
    if w.endswith("eed"):
        w = w[:-1] if m(w[:-3]) > 0 else w
    else:
        for end in ("ed", "ing"):
            if w.endswith(end) and vowel(w[: -len(end)]):
                w = w[: -len(end)]
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif double(w) and w[-1] not in "lsz":
                    w = w[:-1]
                elif m(w) == 1 and cvc(w):
                    w += "e"
                break
    if w.endswith("y") and vowel(w[:-1]):
        w = w[:-1] + "i"
    two = "ational:ate tional:tion enci:ence anci:ance izer:ize bli:ble alli:al entli:ent eli:e ousli:ous ization:ize ation:ate ator:ate alism:al iveness:ive fulness:ful ousness:ous aliti:al iviti:ive biliti:ble logi:log"
    three = "icate:ic ative: alize:al iciti:ic ical:ic ful: ness:"
    for step in (two, three):
        for rule in sorted(step.split(), key=lambda r: -len(r.split(":")[0])):
            end, to = rule.split(":")
            if w.endswith(end):
                if m(w[: -len(end)]) > 0:
                    w = w[: -len(end)] + to
                break
    for end in sorted("al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split(), key=lambda e: -len(e)):
        if w.endswith(end):
            root = w[: -len(end)]
            if m(root) > 1 and (end != "ion" or root.endswith(("s", "t"))):
                w = root
            break
    if w.endswith("e") and (m(w[:-1]) > 1 or (m(w[:-1]) == 1 and not cvc(w[:-1]))):
        w = w[:-1]
    return w[:-1] if w.endswith("ll") and m(w[:-1]) > 1 else w


def _stems(word: pd.Series) -> pd.Series:
    return word.map({w: stem_word(w) for w in word.dropna().unique()})


def porter(word: Column) -> Column:
    return F.pandas_udf(_stems, "string")(word)


def postings(docs: DataFrame, stem: bool = False) -> DataFrame:
    """(id, term, tf, len): the inverted index; len is the document's number of tokens."""
    split = fts_tokens if stem else tokens
    rows = docs.select("id", split(F.col("content")).alias("ts")).select("id", F.size("ts").alias("len"), F.explode("ts").alias("term"))
    out = rows.groupBy("id", "term").agg(F.count("*").alias("tf"), F.first("len").cast("bigint").alias("len"))
    if not stem:
        return out
    stems = out.select("term").distinct().select("term", porter(F.col("term")).alias("s"))
    return out.join(stems, "term").groupBy("id", F.col("s").alias("term")).agg(F.sum("tf").alias("tf"), F.first("len").alias("len"))


def corpus_stats(docs: DataFrame, stem: bool = False) -> DataFrame:
    """One row: the number of documents and their mean length."""
    split = fts_tokens if stem else tokens
    return docs.agg(F.count("*").alias("n"), F.avg(F.size(split(F.col("content")))).alias("avgdl"))


def bm25(docs: DataFrame, query: str, repo: str | None = None, limit: int | None = None, stem: bool = False) -> DataFrame:
    """(id, score). A query word counts as often as it is repeated; document frequencies are over all repos.

    Only the query's terms are counted, so no inverted index is shuffled: each row is reduced to its terms' counts before
    anything moves, and what moves is one row for each match.
    """
    words = re.findall(r"[^\W_]+" if stem else "[a-z0-9]{2,}", query.lower())
    words = [stem_word(w) for w in words] if stem else words
    weights = {w: words.count(w) for w in words}
    if not weights:
        return docs.select("id", F.lit(0.0).alias("score")).limit(0)
    if stem:
        # A stem differs from its word by the end alone, so few words of a text have to be stemmed, where they stand.
        begin = "^(?:" + "|".join(re.escape(w[: max(1, len(w) - 3)]) for w in weights) + ")"
        t = docs.select("id", "repo", fts_tokens(F.col("content")).alias("ts"))
        t = t.select("id", "repo", F.size("ts").cast("double").alias("len"), F.filter("ts", lambda w: w.rlike(begin)).alias("ws")).where(F.size("ws") > 0)
        t = t.select("id", "repo", "len", F.explode("ws").alias("w")).withColumn("term", porter(F.col("w"))).where(F.col("term").isin(list(weights)))
        hit = t.groupBy("id", "repo", "len", "term").agg(F.count("*").cast("double").alias("tf"))
    else:
        t = docs.select("id", "repo", tokens(F.col("content")).alias("ts"))
        t = t.select("id", "repo", F.size("ts").cast("double").alias("len"), F.filter("ts", lambda w: w.isin(list(weights))).alias("ws")).where(F.size("ws") > 0)
        t = t.select("id", "repo", "len", "ws", F.explode(F.array_distinct("ws")).alias("term"))
        hit = t.select("id", "repo", "len", "term", F.size(F.filter("ws", lambda w: w == F.col("term"))).cast("double").alias("tf"))
    df = hit.groupBy("term").agg(F.count("*").alias("df"))  # a row for each word of the query
    table = F.create_map(*[F.lit(x) for w, n in weights.items() for x in (w, float(n))])
    j = hit.join(F.broadcast(df), "term").crossJoin(F.broadcast(corpus_stats(docs, stem)))
    idf = F.ln((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("avgdl"))) * table[F.col("term")]
    if repo is not None:
        j = j.where(F.col("repo") == repo)
    out = j.groupBy("id").agg(F.sum(part).alias("score"))
    return out if limit is None else out.orderBy(F.desc("score"), "id").limit(limit)


def without_files(docs: DataFrame, paths: DataFrame) -> DataFrame:
    """Documents that aren't one of the files nor a symbol in one."""
    gone = paths.select(F.col("path").alias("__f")).distinct()
    return docs.withColumn("__f", F.substring_index("id", "#", 1)).join(gone, "__f", "left_anti").drop("__f")


def split_identifier(name: Column) -> Column:
    spaced = F.regexp_replace(F.regexp_replace(name, "([a-z])([A-Z])", "$1 $2"), "([A-Z]+)([A-Z][a-z])", "$1 $2")
    return F.filter(F.split(spaced, r"[\s_\-]+"), lambda w: w != "")


_VERBS = (
    "add append assert await bind build can catch check clear close concat connect convert create debug decode decrypt delete deserialize disable disconnect dispatch display emit enable"
    " encode encrypt error escape expect fetch filter find format get handle has hash hide init initialize insert is join load log make map merge mock normalize open parse poll process publish"
    " queue read receive reduce register reject remove render reset resolve retry sanitize save schedule send serialize set should show sign sort split start stop subscribe test throw toggle"
    " trace transform unbind unregister unsubscribe update validate verify warn write"
)
VERBS = tuple(_VERBS.split())


def conjugated(verb: Column) -> Column:
    return F.when(verb.rlike("(?i)(?:ch|s|sh|x|z)$"), F.concat(verb, F.lit("es"))).when(verb.rlike("(?i)[^aeiou]y$"), F.concat(F.regexp_replace(verb, "(?i)y$", ""), F.lit("ies"))).otherwise(F.concat(verb, F.lit("s")))


def purpose(name: Column) -> Column:
    """A method's (verb, object, confidence) by its name; null for one that says nothing."""
    words = split_identifier(name)
    first = F.lower(F.get(words, F.lit(0)))
    rest = F.lower(F.array_join(F.slice(words, 2, F.greatest(F.size(words), F.lit(1))), " "))
    make = lambda v, o, c: F.struct(v.alias("verb"), o.alias("object"), c.alias("confidence"))
    many = F.size(words) > 1
    return (
        F.when(many & first.isin("can", "has", "is", "should"), make(F.lit("check"), rest, F.lit(0.8)))
        .when(many & first.isin("handle", "on"), make(F.lit("handle"), F.concat(rest, F.lit(" event")), F.lit(0.75)))
        .when(first.isin(*VERBS), make(first, F.when(many, rest).otherwise("unknown"), F.when(many, 0.85).otherwise(0.5)))
        .when(many, make(F.lit("compute"), F.lower(F.array_join(words, " ")), F.lit(0.4)))
    )


def _any(words: str) -> str:
    return r"\b(?:" + "|".join(sorted(words.split())) + r")\b"


#: (route, confidence, pattern), the first match wins.
ROUTES = [
    ("metrics", 0.9, _any(r"abstractness afferent coupling efferent instability main[\s-]?sequence metrics?")),
    ("flagimpact", 0.9, _any(r"feature[\s-]?flags? flag[\s-]?analysis flag[\s-]?impacts? flag[\s-]?inventor(?:ies|y)")),
    ("blastradius", 0.9, _any(r"affected\s*by blast\s*radius complex(?:ity)? critical high[\s-]?risk hotspot impact important ripple risky")),
    ("synthesis", 0.9, _any(r"narrat(?:e|ion|ive)")),
    ("architecture", 0.9, _any(r"(?:architecture|service)\s+overview architecture cross[\s-]?repo service[\s-]?map topology")),
    ("pattern", 0.85, _any(r"adapters? decorators? facades? factor(?:ies|y) middlewares? observers? patterns? repositor(?:ies|y) singletons?")),
    ("analytical", 0.85, _any(r"changed? history last\s+commit modified recent(?:ly)? updated?")),
    ("structural", 0.9, _any(r"callees? callers? calls? definition depend(?:encies|ency|s)? extends? files? implements? imports? modules? references? used uses")),
    ("faulttree", 0.9, r"\bbasic\s*events?\b|\bfailure\s*(?:analysis|paths?)\b|\bfault\s*trees?\b"),
    ("analytical", 0.85, _any(r"circular config dead diagnostics? errors? failures? faults? flags? gaps? issues? missing orphan risks? unused violations? warnings?")),
    ("documentation", 0.85, _any(r"docs? documentation")),
    ("synthesis", 0.7, _any(r"compare describe design explain how summarize why")),
]


def route(query: Column) -> Column:
    """(route, confidence) of a question."""
    q, out = F.lower(F.trim(query)), None
    for name, confidence, pattern in ROUTES:
        value = F.struct(F.lit(name).alias("route"), F.lit(confidence).alias("confidence"))
        out = F.when(q.rlike(pattern), value) if out is None else out.when(q.rlike(pattern), value)
    return out.otherwise(F.struct(F.lit("search").alias("route"), F.lit(0.5).alias("confidence")))


def scope(query: Column) -> Column:
    """(repos, question): the repos of a leading repo: or repos: prefix, and what follows it."""
    found = F.regexp_extract(query, r"^\s*repos?:([\w.,@/-]+)\s+", 1)
    return F.struct(F.filter(F.split(found, ","), lambda r: r != "").alias("repos"), F.regexp_replace(query, r"^\s*repos?:[\w.,@/-]+\s+", "").alias("question"))


def entities(query: Column) -> Column:
    """Quoted strings, names with inner capitals and dotted paths, in this order, each once."""
    every = lambda p, g=0: F.regexp_extract_all(query, F.lit(p), F.lit(g))
    return F.array_distinct(F.concat(every('"([^"]+)"', 1), every(r"\b[A-Z][a-z]+[A-Z][a-zA-Z]*\b"), every(r"\b[a-z]+[A-Z][a-zA-Z]*\b"), every(r"\b\w+(?:\.\w+)+\b")))


STRUCTURAL = "calls?|depends?|imports?|extends?|implements?|graph|reference|definition"
ANALYTICAL = "risk|fault|error|failure|bug|vulnerability|issue|problem|configuration|flag"


def question_kind(query: Column) -> Column:
    """Which functional-model executor answers a question; a null one is a search."""
    q = F.lower(query)
    return F.when(q.rlike(rf"\b(?:{STRUCTURAL})\b"), "structural").when(q.rlike(rf"\b(?:{ANALYTICAL})\b"), "analytical").otherwise("search")


WILD = "<*>"


class Drain:
    """Greedy templates: the first cluster of equal length that is alike enough takes a message.

    When `clusters` have been made the likest of equal length takes what none of them would; without one the message is left
    out. A message that came before goes where it went as long as no template has changed since.
    """

    def __init__(self, similarity: float, clusters: int):
        self.similarity, self.clusters, self.changes = similarity, clusters, 0
        self.templates: list[list[str]] = []
        self.firsts: list[object] = []  # what each cluster's first message came with
        self.counts: list[int] = []
        self._of_length: dict[int, list[int]] = {}
        self._known: dict[str, tuple[int, int]] = {}

    def add(self, message: str, tag: object = None) -> int | None:
        """The number of the message's cluster."""
        at, when = self._known.get(message, (-1, -1))
        if when != self.changes:
            at = self._placed(message.split(), tag)
            if len(self._known) >= 100_000:  # a memory of what was just done: forgetting it changes no result
                self._known.clear()
            self._known[message] = at, self.changes
        if at < 0:
            return None
        self.counts[at] += 1
        return at

    def _placed(self, words: list[str], tag: object) -> int:
        best, score = -1, -1.0
        for c in self._of_length.get(len(words), []):
            s = sum(t in (w, WILD) for t, w in zip(self.templates[c], words, strict=True)) / len(words) if words else 0.0
            if s > score:
                best, score = c, s
            if s >= self.similarity:
                best = c
                break
        if score < self.similarity and len(self.templates) < self.clusters:
            self._of_length.setdefault(len(words), []).append(len(self.templates))
            self.templates.append(words)
            self.firsts.append(tag)
            self.counts.append(0)
            self.changes += 1
            return len(self.templates) - 1
        if best >= 0:
            merged = [t if t == w else WILD for t, w in zip(self.templates[best], words, strict=True)]
            if merged != self.templates[best]:
                self.templates[best] = merged
                self.changes += 1
        return best


def log_templates(logs: DataFrame, similarity: float = 0.5, clusters: int = 100) -> DataFrame:
    """(repo, severity, template, frequency) of logs (ord, repo, severity, message), in the order of ord.

    The severity leads each message while clustering; a template has that of its first message, and templates that are empty
    without it go. Each message can change what the next one meets, so a repo's messages go through one task in order; they
    stream through it, and what it holds is the templates, `clusters` at most. Null messages are empty ones.
    """
    rows = logs.select("repo", "ord", "severity", F.concat_ws(" ", "severity", "message").alias("message"))
    rows = rows.repartition("repo").sortWithinPartitions("repo", "ord", "message")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, found = None, None

        def out() -> pa.RecordBatch:
            kept = [i for i, t in enumerate(found.templates) if len(t) > 1]
            return pa.RecordBatch.from_arrays(
                [pa.array([last] * len(kept), pa.string()), pa.array([found.firsts[i] for i in kept], pa.string()), pa.array([" ".join(found.templates[i][1:]) for i in kept], pa.string()), pa.array([found.counts[i] for i in kept], pa.int64())],
                ["repo", "severity", "template", "frequency"],
            )

        for batch in batches:
            for repo, severity, message in zip(*(batch.column(c).to_pylist() for c in ("repo", "severity", "message")), strict=True):
                if found is None or repo != last:
                    if found is not None:
                        yield out()
                    last, found = repo, Drain(similarity, clusters)
                found.add(message, severity)
        if found is not None:
            yield out()

    return rows.mapInArrow(run, "repo string, severity string, template string, frequency bigint")


def log_pairs(logs: DataFrame, lines: int = 20, overlap: float = 0.3) -> DataFrame:
    """Pairs of templates of a repo, by the strongest relation: same function, shared traces, same file, joined by a call.

    logs: (repo, id, module, line, traces, calls). Each relation is an equality of its own (on the module, on a trace, on a
    called module), so no repo is joined with itself whole; of a pair's relations the best stays.
    """
    plain = logs.select("repo", "id", "module", "line")
    a, b = (plain.select("repo", F.col("id").alias(f"id_{x}"), "module", F.col("line").alias(f"line_{x}")) for x in "ab")
    mates = a.join(b, ["repo", "module"]).where("id_a < id_b")
    close = F.abs(F.col("line_a") - F.col("line_b")) <= lines
    mates = mates.select("repo", "id_a", "id_b", F.when(close, 0.9).otherwise(0.6).alias("score"), F.when(close, "same-function").otherwise("same-file").alias("relation"))
    traces = logs.select("repo", "id", F.explode(F.array_distinct("traces")).alias("trace"), F.size(F.array_distinct("traces")).alias("n"))
    a, b = (traces.select("repo", "trace", F.col("id").alias(f"id_{x}"), F.col("n").alias(f"n_{x}")) for x in "ab")
    shared = a.join(b, ["repo", "trace"]).where("id_a < id_b").groupBy("repo", "id_a", "id_b").agg(F.count("*").alias("k"), F.first("n_a").alias("n_a"), F.first("n_b").alias("n_b"))
    shared = shared.where(F.col("k") / (F.col("n_a") + F.col("n_b") - F.col("k")) > overlap).select("repo", "id_a", "id_b", F.lit(0.7).alias("score"), F.lit("trace-overlap").alias("relation"))
    calls = logs.select("repo", F.col("id").alias("x"), F.explode(F.array_distinct("calls")).alias("module")).join(plain.select("repo", F.col("id").alias("y"), "module"), ["repo", "module"]).where("x <> y")
    calls = calls.select("repo", F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"), F.lit(0.4).alias("score"), F.lit("call-connected").alias("relation"))
    best = mates.unionByName(shared).unionByName(calls).groupBy("repo", "id_a", "id_b").agg(F.max(F.struct("score", "relation")).alias("m"))
    return best.select("repo", "id_a", "id_b", "m.relation", "m.score")


CONTEXTS = {"database": "database|query|sql", "network": "http|request|api", "authentication": "auth|token|permission", "filesystem": "file|disk", "memory": "memory|heap"}


def shared_context(groups: DataFrame) -> DataFrame:
    """(group_id, context): the keyword family that most of a group's templates match, if at least half of them do.

    groups: (group_id, ord, template). Of families that are matched equally often the one that is matched first counts, and
    of those that the same template matches first, the one that comes first in CONTEXTS.
    """
    families = F.array(*[F.struct(F.lit(n).alias("context"), F.lit(-i).alias("rank"), F.lower("template").rlike(p).alias("hit")) for i, (n, p) in enumerate(CONTEXTS.items())])
    hits = groups.select("group_id", "ord", F.explode(families).alias("h")).select("group_id", "ord", "h.*")
    per = hits.groupBy("group_id", "context", "rank").agg(F.count_if("hit").alias("k"), F.count("*").alias("n"), (-F.min(F.when(F.col("hit"), F.col("ord")))).alias("first"))
    per = per.where((F.col("k") > 0) & (F.col("k") >= F.ceil(F.col("n") / 2)))
    return per.groupBy("group_id").agg(F.max_by("context", F.struct("k", "first", "rank")).alias("context"))


def log_roots(templates: DataFrame) -> DataFrame:
    """Error and warning templates as failure roots, with a severity that negations lower."""
    text = F.lower("template")
    negated = text.rlike(r"\b(?:no|not|without)\s+(?:an?\s+)?(?:crash|critical|fatal)")
    level = F.when(text.rlike(r"\b(?:crash|critical|fatal)") & ~negated, "critical").when(F.col("severity") == "error", "high").otherwise("medium")
    return templates.where(F.col("severity").isin("error", "warn")).withColumn("level", level)
