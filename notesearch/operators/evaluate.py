"""Known-item test collections and the measures of set and ranked retrieval."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import tokens
from ..session import stable
from .correct import reference_readings
from .expand import ALWAYS, FALLBACK, NEVER, expand, words_of
from .index import Index
from .search import BM25, NO_SCORE, TFIDF, intersections, ranks_of_models, scores_of_all, search, skip_costs
from .similarity import near_words

#: A term in more than one of so many lines is frequent; there are at most so many times the terms of a line.
COMMON = 1000
#: Share of the model name that a wildcard query keeps, and the shortest model name asked for.
KEPT, SHORTEST_MODEL = 0.6, 5


def known_items(lines: DataFrame) -> DataFrame:
    """code, exact, wildcard, has_variants: two queries for each code with several lines.

    lines has doc, code and descr; the indexed text is code and description.
    """
    full = lines.select("doc", "code", F.concat_ws(" ", "code", "descr").alias("descr"))
    t = reference_readings(full).select("code", tokens(F.col("descr")).alias("t")).filter((F.size("t") >= 4) & (F.length(F.col("t")[2]) >= SHORTEST_MODEL))
    asked = t.select("code", F.col("t")[2].alias("model"), F.col("t")[3].alias("word"))
    read = full.select("code", tokens(F.col("descr")).alias("t"))
    missing = F.expr("NOT array_contains(t, model) OR NOT array_contains(t, word)")
    varied = read.join(asked, "code").groupBy("code", "model", "word").agg(F.bool_or(missing).alias("has_variants"))
    start = F.expr(f"substring(model, 1, cast(ceil(length(model) * {KEPT}D) as int))")
    return varied.select("code", F.concat_ws(" ", "model", "word").alias("exact"), F.concat(start, F.lit("*")).alias("wildcard"), "has_variants")


def collection(lines: DataFrame, kind: str = "exact") -> tuple[DataFrame, DataFrame]:
    """queries (query_id, text, has_variants) and qrels (query_id, doc): all lines of the code are relevant."""
    items = stable(known_items(lines))
    queries = items.select(F.col("code").alias("query_id"), F.col(kind).alias("text"), "has_variants")
    return queries, lines.select(F.col("code").alias("query_id"), "doc").join(items.select(F.col("code").alias("query_id")), "query_id", "left_semi")


def set_measures(results: DataFrame, queries: DataFrame, qrels: DataFrame, n_docs: DataFrame) -> DataFrame:
    """query_id, has_variants, precision, recall, f1, accuracy; n_docs is one row (n)."""
    both = results.select("query_id", "doc", F.lit(True).alias("got")).join(qrels.withColumn("relevant", F.lit(True)), ["query_id", "doc"], "full")
    counts = both.groupBy("query_id").agg(F.count_if(F.col("got") & F.col("relevant")).alias("tp"), F.count("got").alias("returned"), F.count("relevant").alias("relevant"))
    return _measures(counts, queries, n_docs)


def class_measures(results: DataFrame, queries: DataFrame, held: DataFrame, n_docs: DataFrame) -> DataFrame:
    """set_measures of results (query_id, doc) that are classes of lines, for several systems at once.

    held has the classes; query_id is a struct (system, code), and all lines of the code are relevant.
    """
    relevant = held.groupBy("code").agg(F.sum("n").alias("relevant"))
    same = F.col("code") == F.col("query_id")["code"]
    hits = results.join(held.select("doc", "code", "n"), "doc").groupBy("query_id").agg(F.sum(F.when(same, F.col("n"))).alias("tp"), F.sum("n").alias("returned"))
    counts = queries.select("query_id", F.col("query_id")["code"].alias("code")).join(relevant, "code").drop("code").join(hits, "query_id", "left")
    return _measures(counts, queries, n_docs)


def _measures(counts: DataFrame, queries: DataFrame, n_docs: DataFrame) -> DataFrame:
    c = queries.join(counts, "query_id", "left").fillna(0, ["tp", "returned", "relevant"]).crossJoin(F.broadcast(n_docs.select("n")))
    p = F.when(F.col("returned") > 0, F.col("tp") / F.col("returned")).otherwise(0.0)
    r = F.when(F.col("relevant") > 0, F.col("tp") / F.col("relevant")).otherwise(0.0)
    wrong = F.col("returned") + F.col("relevant") - 2 * F.col("tp")
    c = c.withColumns({"precision": p, "recall": r})
    f1 = F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0)
    return c.select("query_id", "has_variants", "precision", "recall", f1.alias("f1"), ((F.col("n") - wrong) / F.col("n")).alias("accuracy"))


def rank_measures(ranked: DataFrame, queries: DataFrame, qrels: DataFrame) -> DataFrame:
    """query_id, has_variants, ap, p1, r_precision; average precision is over all relevant documents."""
    size = qrels.groupBy("query_id").agg(F.count(F.lit(1)).alias("relevant"))
    hits = ranked.select("query_id", "rank", "doc").join(qrels, ["query_id", "doc"], "left_semi")
    so_far = F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))
    hits = hits.withColumn("so_far", so_far).join(size, "query_id")
    per = hits.groupBy("query_id", "relevant").agg(F.sum(F.col("so_far") / F.col("rank")).alias("sum_p"), F.count_if(F.col("rank") == 1).alias("first"), F.count_if(F.col("rank") <= F.col("relevant")).alias("early"))
    measured = per.select("query_id", (F.col("sum_p") / F.col("relevant")).alias("ap"), F.col("first").cast("double").alias("p1"), (F.col("early") / F.col("relevant")).alias("r_precision"))
    return queries.select("query_id", "has_variants").join(measured, "query_id", "left").fillna(0.0)


def averages(measures: DataFrame, system: str) -> DataFrame:
    """system, subset (all, variants), n and the mean of each measure at six digits."""
    return _averages(measures, measures.agg).select(F.lit(system).alias("system"), "r.*")


def averages_of(measures: DataFrame, systems: list[str]) -> DataFrame:
    """averages of several systems in their order; query_id is a struct (system, code), where system is the place in the list."""
    each = _averages(measures, measures.groupBy(F.col("query_id")["system"].alias("place")).agg)
    name = F.array(*map(F.lit, systems))[F.col("place")]
    return each.orderBy("place", "r.subset").select(name.alias("system"), "r.*")


def _averages(measures: DataFrame, agg) -> DataFrame:
    names = [c for c in measures.columns if c not in ("query_id", "has_variants")]
    subsets = {"all": lambda c: c, "variants": lambda c: F.when(F.col("has_variants"), c)}
    rows = [F.struct(F.lit(subset).alias("subset"), F.count(of(F.lit(1))).alias("n"), *(F.round(F.avg(of(F.col(c))), 6).alias(c) for c in names)) for subset, of in subsets.items()]
    return agg(F.array(*rows).alias("rows")).withColumn("r", F.explode("rows"))


def _stack(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


def _expanded(terms: DataFrame, queries: DataFrame, mode: str) -> DataFrame:
    """word, term: what the words of all queries stand for, computed once."""
    words = words_of(queries).select(F.lit(0).alias("query_id"), "word").distinct()
    return stable(expand(words, terms, mode).select("word", "term"), "expansions")


def classes(lines: DataFrame, terms: DataFrame, asked: DataFrame, common: int = COMMON) -> DataFrame:
    """doc, code, held, n: lines of one code that hold the same terms count as one document; held joins the terms by spaces.

    Frequent terms (in more than one of `common` lines) that asked (term) does not have are left out: no search can
    tell lines apart by them.  All other terms stay, so sets found among classes are those found among lines.
    """
    frequent = terms.filter(F.col("df") * common > lines.count()).join(asked, "term", "left_anti")
    ignored = [r["term"] for r in frequent.select("term").collect()]
    held = F.array_distinct(tokens(F.concat_ws(" ", "code", "descr")))
    held = F.filter(held, lambda t: ~t.isin(ignored)) if ignored else held
    alike = lines.select("code", F.array_join(F.array_sort(held), " ").alias("held")).groupBy("code", "held").agg(F.count(F.lit(1)).alias("n"))
    return stable(alike.withColumn("doc", F.monotonically_increasing_id()), "classes")


def _asked_items(items: DataFrame, kind: str = "exact") -> DataFrame:
    return items.select(F.col("code").alias("query_id"), F.col(kind).alias("text"), "has_variants")


def _class_averages(lines: DataFrame, held: DataFrame, postings: DataFrame, terms: DataFrame, systems: list[tuple]) -> DataFrame:
    """averages of systems (name, prefix, queries, words, expansions), searched in one plan.

    postings and terms are of all indexes, each with its prefix before its terms.  Words get the number of their system.
    """
    stacked, one = [], lambda k, c: F.struct(F.lit(k).alias("system"), F.col(c).alias("code")).alias("query_id")
    for k, (_, prefix, queries, words, near) in enumerate(systems):
        mine = F.concat(F.lit(f"{k} "), "word").alias("word")
        stacked.append((queries.select(one(k, "query_id"), "text", "has_variants"), words.select(one(k, "query_id"), mine), near.select(mine, F.concat(F.lit(prefix), "term").alias("term"))))
    queries, words, expansions = (_stack(list(frames)) for frames in zip(*stacked))
    index = Index(held, postings, terms, held, held)
    n_docs = lines.agg(F.count(F.lit(1)).alias("n"))
    return averages_of(class_measures(search(index, queries, words=stable(words, "words"), expansions=stable(expansions, "expansions")), queries, held, n_docs), [name for name, *_ in systems])


def _class_postings(held: DataFrame) -> DataFrame:
    return stable(held.filter("held <> ''").select(F.explode(F.split("held", " ")).alias("term"), "doc", F.lit(1).alias("tf")), "postings")


def _prefixed(frames: dict[str, DataFrame]) -> DataFrame:
    return stable(_stack([frame.withColumn("term", F.concat(F.lit(prefix), "term")) for prefix, frame in frames.items()]), "prefixed")


def vector_system(index: Index, lines: DataFrame, vectors: DataFrame, items: DataFrame | None = None) -> DataFrame:
    """Set measures of search over the neighbours of each word, over classes of lines; vectors has term and vec."""
    queries = _asked_items(stable(known_items(lines), "items") if items is None else items)
    words, near = near_words(queries, vectors)
    held = classes(lines, index.terms, near.select("term"))
    return _class_averages(lines, held, _class_postings(held), index.terms, [("vector neighbours", "", queries, words, near)])


def set_matrix(index: Index, corrected: Index, lines: DataFrame, vectors: DataFrame | None = None) -> DataFrame:
    """Set measures of the five exact-query systems and the two wildcard ones; with vectors of terms also of search over neighbours.

    Searches run over classes of lines.  Of index the dictionary is read, of corrected the corrections.  Similar spellings
    and matches are looked up once in the terms of both; each system takes what its own dictionary has.
    """
    if corrected.fixes is None:
        raise ValueError("the corrected index must come from corrected_index")
    items = stable(known_items(lines), "items")
    fixes = stable(corrected.fixes.select("term", "fixed"), "fixes")
    right = F.coalesce("fixed", "term").alias("term")
    fixed_terms = stable(index.terms.join(fixes, "term", "left").groupBy(right).agg(F.sum("df").alias("df")), "terms")
    exact, wild = _asked_items(items), _asked_items(items, "wildcard")
    words = stable(words_of(exact), "words")
    every = index.terms.select("term").unionByName(fixed_terms.select("term")).distinct()
    similar, matches = _expanded(every, exact, ALWAYS), _expanded(every, wild, NEVER)
    own = words.select("word", F.col("word").alias("term")).distinct()
    at = {"= ": index.terms.select("term"), "~ ": fixed_terms.select("term")}
    known = {prefix: lambda e, t=terms: e.join(t, "term", "left_semi").select("word", "term") for prefix, terms in at.items()}
    absent = own.join(at["= "], "term", "left_anti").select("word")
    fallback = known["= "](own).unionByName(known["= "](similar).join(absent, "word", "left_semi"))
    wild_words = words_of(wild)
    systems = [
        ("exact", "= ", exact, words, known["= "](own)),
        ("fuzzy if absent", "= ", exact, words, fallback),
        ("fuzzy always", "= ", exact, words, known["= "](similar)),
        ("corrected", "~ ", exact, words, known["~ "](own)),
        ("corrected, fuzzy always", "~ ", exact, words, known["~ "](similar)),
        ("wildcard", "= ", wild, wild_words, known["= "](matches)),
        ("wildcard, corrected", "~ ", wild, wild_words, known["~ "](matches)),
    ]
    asked = _stack([*(e.select("term") for e in (own, similar, matches)), fixes.select("term"), fixes.select(F.col("fixed").alias("term"))])
    held = classes(lines, index.terms, asked)
    plain = _class_postings(held)
    fixed = plain.join(fixes, "term", "left").select(right, "doc", "tf").distinct()
    out = _class_averages(lines, held, _prefixed({"= ": plain, "~ ": fixed}), _prefixed({"= ": index.terms, "~ ": fixed_terms}), systems)
    return out if vectors is None else out.unionByName(vector_system(index, lines, vectors, items))


def rank_matrix(index: Index, lines: DataFrame) -> DataFrame:
    """Rank measures of eight orderings."""
    queries, qrels = collection(lines)
    names = {"and": [NO_SCORE, TFIDF, BM25], "or": [NO_SCORE, TFIDF, BM25], "fuzzy always, and": [TFIDF, BM25]}
    expansions = {mode: _expanded(index.terms, queries, mode) for mode in (NEVER, ALWAYS)}
    either = ranks_of_models(index, queries, qrels, names["or"], expansions=expansions[NEVER])
    frames = {}
    for kind, mode in (("and", NEVER), ("fuzzy always, and", ALWAYS)):
        met = scores_of_all(index, queries, names[kind], expansions[mode])
        met = stable(met.join(qrels, ["query_id", "doc"], "left_semi"), "ranks")  # measures read the ranks of relevant documents only
        frames |= {(kind, m): met.select("query_id", "doc", F.col(m).alias("rank")) for m in names[kind]}
    frames |= {("or", m): either[m] for m in names["or"]}
    return _stack([averages(rank_measures(frames[kind, m], queries, qrels), f"{kind} {m}") for kind, models in names.items() for m in models])


def workloads(index: Index, lines: DataFrame) -> DataFrame:
    """workload, pair_id, a, b: the two terms of each exact query, and its first term with the most frequent one (of equals the least)."""
    asked = known_items(lines).select(F.col("code").alias("pair_id"), F.split("exact", " ").alias("t"))
    frequent = index.terms.orderBy(F.desc("df"), "term").limit(1).select(F.col("term").alias("frequent"))
    pairs = asked.crossJoin(F.broadcast(frequent))
    kinds = F.array(F.struct(F.lit("query terms").alias("workload"), F.col("t")[1].alias("b")), F.struct(F.lit("most frequent").alias("workload"), F.col("frequent").alias("b")))
    each = pairs.select("pair_id", F.col("t")[0].alias("a"), F.explode(kinds).alias("k"))
    return each.select("k.workload", "pair_id", "a", "k.b")


def efficiency(index: Index, lines: DataFrame, skips: bool = True) -> DataFrame:
    """workload, n_queries, linear, skip (only skips): comparisons over all exact queries."""
    work = stable(workloads(index, lines).withColumn("query", F.col("pair_id")).withColumn("pair_id", F.concat_ws("\n", "workload", "pair_id")), "workloads")
    pairs = work.select("pair_id", "a", "b")
    costs, sums = intersections(index, pairs), [F.count(F.lit(1)).alias("n_queries"), F.sum("linear_cost").alias("linear")]
    if skips:
        costs, sums = costs.join(skip_costs(index, pairs), "pair_id"), [*sums, F.sum("skip_cost").alias("skip")]
    return work.select("workload", "pair_id").join(costs, "pair_id").groupBy("workload").agg(*sums)


def report(sets: DataFrame, ranks: DataFrame, work: DataFrame) -> list[str]:
    """Lines of text: a table of set measures, one of rank measures, and the comparisons of intersections.

    The three frames have a row for each system, ordering or workload, so they are small.
    """
    out = []
    for frame, names, heads, digits in ((sets, ("precision", "recall", "f1", "accuracy"), ("P", "R", "F1", "acc"), (3, 3, 3, 4)), (ranks, ("ap", "p1", "r_precision"), ("MAP", "P@1", "R-prec"), (3, 3, 3))):
        out += ["", f"{'system':<31} {'set':<12} " + "  ".join(f"{h:>{d + 2}}" for h, d in zip(heads, digits))]
        before = None
        for row in frame.collect():
            shown = "" if row["system"] == before else row["system"]
            out.append(f"{shown:<31} {row['subset']:<12} " + "  ".join(f"{row[c] or 0.0:>{d + 2}.{d}f}" for c, d in zip(names, digits)) + f"  (n={row['n']})")
            before = row["system"]
    out += ["", "comparisons of document numbers (intersection of two terms)"]
    return out + [f"  {r['workload']:<20} {r['n_queries']} queries: linear {r['linear']}, with skips {r['skip']}" for r in work.orderBy("workload").collect()]
