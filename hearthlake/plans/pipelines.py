"""The end-to-end jobs, each a composition of operators."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hearthlake import vocab
from hearthlake.functions import numbers as N
from hearthlake.functions import text as X
from hearthlake.models.estimators import MedianBaseline, Ridge, boosting, with_early_stop
from hearthlake.models.preparation import Preparation, column_roles, modelling_frame
from hearthlake.models.scoring import cross_validate, regression_metrics
from hearthlake.models.search import default_score, search
from hearthlake.models.splitting import require_no_leak
from hearthlake.operators import amenities as A
from hearthlake.operators import correlation as C
from hearthlake.operators import encoding, enrichment, extraction, filters, linkage, repair, reports
from hearthlake.operators.joins import pending
from hearthlake.operators.ranks import exact_slice, hash_shard
from hearthlake.session import cut_lineage, drop_unreachable
from hearthlake.sources.markup import sitemap_links

AMENITY_LISTS = ["comodidades_area_privativa", "comodidades_area_comum"]


# --- Merge of part files -----------------------------------------------------------------------

def merge_parts(parts: DataFrame, order: list[str], source: str = "source_file") -> tuple[DataFrame, DataFrame]:
    """First-wins merge by URL, and the new rows each file contributed."""
    helpers = [c for c in order if c in parts.columns]
    merged = linkage.first_wins(parts, vocab.URL, order).drop(*helpers)
    return merged, linkage.new_per_source(parts, vocab.URL, source, order)


# --- Normalised tables -------------------------------------------------------------------------

@dataclass
class NormalizedTables:
    properties: DataFrame
    cities: DataFrame
    neighborhoods: DataFrame
    amenities: DataFrame
    rel_amenities: DataFrame
    totals: DataFrame
    dropped: DataFrame


def property_rows(listings: DataFrame, city_slug: str = "pb-joao-pessoa", names: dict | None = None) -> DataFrame:
    """Star-schema property rows; curated fields are typed NULLs."""
    empty = F.lit(None)
    text = F.col(vocab.DESCRIPTION)
    tokens = F.col("_tokens")
    price = N.money_to_int(vocab.PRICE)
    return listings.withColumn("_tokens", X.comma_tokens(*AMENITY_LISTS)).select(
        X.listing_id(vocab.URL).alias("id"),
        X.strip_space(F.coalesce(F.col(vocab.TITLE), F.lit(""))).alias("title"),
        F.lit("Apartment").alias("subtype"),
        F.lit("sale").alias("transaction"),
        F.nullif(price, F.lit(0).cast("bigint")).alias("price_sale"),
        empty.cast("bigint").alias("price_rent"),
        N.usable_area(vocab.AREA, vocab.TOTAL_AREA).alias("area_m2"),
        N.first_int("quartos").alias("bedrooms"),
        N.first_int("banheiros").alias("bathrooms"),
        N.first_int("garagens").alias("parking_spots"),
        empty.cast("double").alias("iptu_year"),
        empty.cast("double").alias("condo_fee"),
        X.keyword_flag(tokens, text, "pets_allowed").alias("pets_allowed"),
        empty.cast("boolean").alias("accepts_financing"),
        empty.cast("int").alias("year_built"),
        empty.cast("int").alias("floor"),
        X.keyword_flag(tokens, text, "has_elevator").alias("has_elevator"),
        X.keyword_flag(tokens, text, "has_balcony").alias("has_balcony"),
        X.keyword_flag(tokens, text, "furnished").alias("furnished"),
        X.place_from_url(vocab.URL, city_slug, names).alias("neighborhood"),
        empty.cast("string").alias("condominium"),
        empty.cast("string").alias("builder"),
        empty.cast("int").alias("built_year"),
    )


def normalize_listings(
    listings: DataFrame, city: str, state: str, city_slug: str = "pb-joao-pessoa", names: dict | None = None
) -> NormalizedTables:
    properties = property_rows(listings, city_slug, names)
    keyed = listings.withColumn("_id", X.listing_id(vocab.URL))
    tokens = A.listing_tokens(keyed, "_id", *AMENITY_LISTS)
    edges = A.amenity_edges(tokens, "_id")
    medians = reports.median_price_per_area(properties, "neighborhood", "price_sale", "area_m2")
    return NormalizedTables(
        properties=properties,
        cities=listings.sparkSession.createDataFrame([(city, state)], "name string, state string"),
        neighborhoods=reports.place_table(medians, city),
        amenities=A.amenities_used(edges),
        rel_amenities=edges,
        totals=reports.property_totals(properties),
        dropped=A.top_counts(A.dropped_tokens(tokens), "token", "cnt", 15),
    )


# --- Amenity matrix ----------------------------------------------------------------------------

def amenity_matrix(
    listings: DataFrame, at_least: int = vocab.MIN_AMENITY_LISTINGS, columns: list[str] = AMENITY_LISTS,
    names: list[str] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """0/1 amenity columns per URL for `names`, or the frequent amenities, and the full frequency table."""
    keyed = listings.where(F.col(vocab.URL).isNotNull() & (F.col(vocab.URL) != "")).select(
        vocab.URL, A.canonical_set(*columns).alias("_set")
    )
    frequency = A.amenity_frequency(keyed, "_set")
    if names is None:
        names = A.column_values(A.frequent_amenities(frequency, at_least), "amenity")
    return A.amenity_matrix(keyed, vocab.URL, "_set", names), frequency


# --- Per-portal master -------------------------------------------------------------------------

def build_master(
    listings: DataFrame, extractions: DataFrame, terms: list[str], scraped: Column,
    names: list[str] | None = None, order: list[str] | None = None,
) -> DataFrame:
    """Listings with extraction columns; scraped amenities OR-ed in and kept as 'comodidade_' flags.

    `scraped` is an array column of scraped flag names per listing, `names` the flags to keep as columns
    (all that occur by default). Of several extractions of a URL the last in `order` counts.
    """
    marked = listings.withColumn("_scraped", scraped)
    if names is None:
        names = A.column_values(marked.select(F.explode("_scraped").alias("name")), "name")
    joined = extraction.with_extractions(marked, extractions, terms, order)
    ored = joined.withColumn(
        "extraction",
        F.col("extraction").withField(
            "flags", extraction.or_scraped_flags(F.col("extraction.flags"), F.col("_scraped"))
        ),
    )
    flat = extraction.flatten_extraction(ored, terms)
    return flat.select(
        *[F.col(f"`{c}`") for c in flat.columns if c != "_scraped"],
        *[F.array_contains("_scraped", n).alias(n) for n in names if n not in flat.columns],
    )


def pending_extractions(listings: DataFrame, extractions: DataFrame | None) -> DataFrame:
    """Listings whose URL has no stored extraction."""
    if extractions is None:
        return listings
    seen = extractions.select(vocab.URL).distinct()
    return listings.where(F.col(vocab.URL).isNotNull()).join(seen, vocab.URL, "left_anti")


def extraction_job(
    listings: DataFrame, stored: DataFrame | None, terms: list[str], extractor: extraction.Extractor | None = None,
    reset: bool = False, first: int | None = None,
) -> DataFrame:
    """Stored extractions plus those of listings without one, for the caller to write.

    `reset` starts over; `first` takes that many pending listings in URL order, by default all.
    """
    known = None if reset else stored
    todo = pending_extractions(listings, known)
    if first is not None:
        todo = todo.orderBy(vocab.URL).limit(first)
    found = extraction.extract_attributes(todo, terms, extractor)
    return found if known is None else known.unionByName(found)


# --- Cross-portal deduplication ----------------------------------------------------------------

@dataclass
class DedupResult:
    units: DataFrame
    extras: DataFrame
    summary: DataFrame


def deduplicate_portals(
    first: DataFrame, second: DataFrame, seq: str = "row_seq",
    labels: tuple[str, str] = ("portal_a", "portal_b"),
) -> DedupResult:
    """Linked and merged units of two portals; the first portal's rows rank before the second's.

    `extras` holds the unique extras of every unit as rows (unit_key, extra).
    """
    linked = linkage.union_portals(
        linkage.with_link_columns(first, F.lit(labels[0])).withColumn("_portal_rank", F.lit(0)),
        linkage.with_link_columns(
            second, F.lit(labels[1]), vocab.PLACE if vocab.PLACE in second.columns else None
        ).withColumn("_portal_rank", F.lit(1)),
    )
    surrogate = F.concat_ws(":", "_portal_rank", seq)
    keyed = linked.withColumn("unit_key", linkage.unit_key(surrogate=surrogate))
    flags = [f.name for f in keyed.schema.fields if isinstance(f.dataType, T.BooleanType)]
    units = linkage.merge_units(keyed, "unit_key", ["_portal_rank", seq], flags)
    if vocab.EXTRAS in keyed.columns:
        extras = linkage.unit_extras(keyed, "unit_key")
    else:
        extras = keyed.sparkSession.createDataFrame([], "unit_key string, extra string")
    return DedupResult(units, extras, linkage.merge_summary(keyed, "unit_key"))


# --- Feature matrix ----------------------------------------------------------------------------

def feature_matrix(
    master: DataFrame, raw: DataFrame | None = None, raw_order: list[str] | None = None,
    categories: dict[str, list[str]] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Numeric matrix and its long report (step, key, value).

    Order: repair, flag folding, number conversion, plausibility, prose fill, flag filter, place,
    one-hot, dummy filter. The frame is cut where several passes read it: after the join with `raw`, after the parsers, and before the
    vocabulary passes.
    """
    spark = master.sparkSession
    notes: list[tuple[str, str, float]] = []
    parts: list[DataFrame] = []

    def note(step: str, values: dict) -> None:
        notes.extend((step, k, float(v)) for k, v in values.items())

    df = master
    if raw is not None:
        df, repaired = repair.repair_and_count(df, raw, raw_order or ["row_seq"])
        parts.append(repaired.select(
            F.lit("repaired").alias("step"), F.col("column").alias("key"),
            F.col("repaired").cast("double").alias("value"),
        ))
    flags = filters.boolean_columns(df)
    groups = A.flag_groups(flags)
    df = A.fold_flags(df, flags)
    note("flags", {"source": len(flags), "canonical": len(groups)})
    note("merged_flags", {k: len(v) for k, v in groups.items() if len(v) > 1})
    df = cut_lineage(repair.to_numeric_columns(df))
    parts.append(filters.implausible_counts(df).select(
        F.lit("implausible").alias("step"), F.col("column").alias("key"),
        F.col("out_of_range").cast("double").alias("value"),
    ))
    df = filters.null_implausible(df)
    parts.append(enrichment.fill_counts(df).select(
        F.lit("filled_from_prose").alias("step"), F.col("field").alias("key"),
        F.col("filled").cast("double").alias("value"),
    ))
    df = cut_lineage(encoding.fill_place(enrichment.fill_from_prose(df)))
    folded = [vocab.FLAG_PREFIX + g for g in groups]
    df, outcome = A.filter_flag_columns(df, folded)
    note("flag_filter", {k: len(v) for k, v in outcome.items()})
    df = encoding.fold_rare(df, vocab.PLACE)
    df, dummies = encoding.one_hot(df, [*vocab.CATEGORICAL_COLUMNS, vocab.PLACE], categories)
    df, dropped = encoding.filter_dummies(df, dummies)
    note("dummies_dropped", {d: 1 for d in dropped})
    df = filters.drop_free_text(df)
    note("shape", {"input_columns": len(master.columns), "output_columns": len(df.columns)})
    rows = df.agg(F.lit("shape").alias("step"), F.lit("rows").alias("key"), F.count(F.lit(1)).cast("double").alias("value"))
    report = reduce(
        DataFrame.unionByName, parts + [rows],
        spark.createDataFrame(notes, "step string, key string, value double"),
    )
    return df, report


def enrichment_diagnostics(
    master: DataFrame, raw: DataFrame | None = None, raw_order: list[str] | None = None
) -> dict[str, DataFrame]:
    """Usable texts, prose precision, missingness around the fill, and the filled frame."""
    df = master if raw is None else repair.repair_numerics(master, raw, raw_order or ["row_seq"])
    df = filters.null_implausible(repair.to_numeric_columns(df))
    usable = X.substantial_text(vocab.DESCRIPTION)
    return {
        "usable": df.agg(F.count_if(usable).alias("usable"), F.avg(usable.cast("double")).alias("share")),
        "precision": enrichment.extraction_precision(df),
        "missingness": enrichment.missingness(df),
        "filled": enrichment.fill_from_prose(df),
    }


# --- Feature selection -------------------------------------------------------------------------

@dataclass
class Selection:
    ranking: DataFrame
    correlations: DataFrame
    artifacts: DataFrame
    decisions: DataFrame
    selected: DataFrame
    names: list[str]


def select_features(matrix: DataFrame) -> Selection:
    """Rank features against the price, find source artefacts, prune redundant ones.

    Only numbers are kept for the passes; what follows from the price is worked out from them again.
    """
    used = [c for c in matrix.columns if c in {*filters.numeric_columns(matrix), vocab.PRICE, vocab.AREA}]
    df, targets = C.with_targets(cut_lineage(matrix.where(F.col(vocab.PRICE) > 0).select(*[F.col(f"`{c}`") for c in used])))
    drop_unreachable(matrix.sparkSession)
    candidates = [c for c in filters.numeric_columns(df) if c not in targets]
    features = filters.varying_columns(df, candidates)
    ranking = cut_lineage(C.rank_features(df, features, targets))
    pairs = cut_lineage(C.spearman_pairs(df, C.all_pairs(features)))
    origins = [c for c in features if c.startswith(vocab.ORIGIN + "_")]
    names, decisions = C.prune_redundant(pairs, ranking, features)
    return Selection(
        C.strongest_first(ranking), pairs, C.source_artifacts(df, features, origins), decisions,
        C.selected_ranking(ranking, names), names,
    )


# --- Models ------------------------------------------------------------------------------------

def regressors(models: list[str], boosting_params: dict | None = None, stop_on: str | None = None) -> dict:
    """The named regressors in their default or tuned settings; `stop_on` ends boosting early."""
    make = {
        "baseline_mediana": lambda: MedianBaseline(),
        "ridge": lambda: Ridge(alpha=1.0),
        "gradient_boosting": lambda: boosting(**(boosting_params or vocab.BOOSTING_DEFAULT), stop_on=stop_on),
        "gradient_boosting_ajustado": lambda: boosting(**(boosting_params or vocab.BOOSTING_TUNED), stop_on=stop_on),
    }
    return {name: make[name]() for name in models}


def train_models(
    matrix: DataFrame, models: list[str], folds: int = vocab.FOLDS, boosting_params: dict | None = None
) -> DataFrame:
    """One row per model: grouped CV score on the training side, metrics on the held-out groups.

    Boosting stops early on more than EARLY_STOP_ABOVE training rows, on groups of its own.
    """
    frame, features = modelling_frame(matrix, folds=folds)
    frame = cut_lineage(frame)
    require_no_leak(frame, "group_key")
    train, stop_on = with_early_stop(frame.where(~F.col("is_test")))
    test = frame.where("is_test")
    numeric, flags = column_roles(features)
    prepare = Preparation(numeric=numeric, flags=flags)
    chosen = regressors(models, boosting_params, stop_on)
    scores, fitted, prepared = cross_validate(train, prepare, chosen, folds)
    held = prepared.transform(test)
    out, summary = None, []
    for name, model in fitted.items():
        predicted = model.transform(held).select(
            F.lit(name).alias("modelo"), "label", "prediction"
        )
        out = predicted if out is None else out.unionByName(predicted)
        mean = sum(scores[name]) / len(scores[name])
        spread = (sum((s - mean) ** 2 for s in scores[name]) / len(scores[name])) ** 0.5
        summary.append((name, mean, spread))
    cv = matrix.sparkSession.createDataFrame(
        summary, "modelo string, cv_mae_log_media double, cv_mae_log_desvio double"
    )
    metrics = regression_metrics(out, by=["modelo"])
    return F.broadcast(cv).join(metrics, "modelo").orderBy("cv_mae_log_media")


def tune_models(
    matrix: DataFrame, grids: dict[str, dict[str, list] | None], folds: int = vocab.FOLDS
) -> tuple[DataFrame, DataFrame]:
    """Best row per model with its gain over the default, and every grid point."""
    frame, features = modelling_frame(matrix, folds=folds)
    frame = cut_lineage(frame)
    require_no_leak(frame, "group_key")
    train, test = frame.where(~F.col("is_test")), frame.where("is_test")
    numeric, flags = column_roles(features)
    best, table = None, None
    for name, grid in grids.items():
        fitted, results = search(train, numeric, flags, name, grid, folds)
        default = default_score(results, name)
        top = results.orderBy("mean_test_score").limit(1).select(
            "modelo", F.col("mean_test_score").alias("cv_mae_log_melhor"),
            F.lit(default).alias("cv_mae_log_padrao"), F.lit(results.count()).alias("configuracoes"),
            "alpha", "learning_rate", "max_iter", "max_leaf_nodes", "min_samples_leaf", "l2_regularization",
        )
        metrics = regression_metrics(fitted.transform(test)).withColumn("modelo", F.lit(name))
        row = top.join(F.broadcast(metrics), "modelo")
        best = row if best is None else best.unionByName(row)
        table = results if table is None else table.unionByName(results)
    return best, table


# --- Crawl planning ----------------------------------------------------------------------------

def plan_crawl(
    sitemaps: DataFrame, seen: DataFrame, text: str, city: str, kind: str, deal: str = "venda",
    shards: int = 1, shard: int = 0, exact: bool = False, first: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Links this worker should fetch, and the plan's counts.

    `exact` slices the sorted pending links as `links[shard::shards]`; the default assigns by hash.
    `first` keeps that many of the worker's links in URL order; by default all.
    """
    links = sitemap_links(sitemaps, text).where(filters.link_in_scope("url", city, kind, deal))
    todo = pending(links, [seen])
    mine = todo
    if shards > 1:
        mine = exact_slice(todo, ["url"], shard, shards) if exact else todo.where(hash_shard("url", shards) == shard)
    counts = reports.run_plan(links, seen, "url", shards, shard, exact)
    return (mine if first is None else mine.orderBy("url").limit(first)), counts
