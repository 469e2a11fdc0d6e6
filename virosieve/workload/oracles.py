"""SQL counterparts of the registered queries, written from the definition of each operator and not
from its Spark plan. DuckDB runs them on the same parquet files."""

from __future__ import annotations

from virosieve.workload.binding import WHOLE_EDGES, on_all_edges, on_nucleotides, with_clause
from virosieve.workload.queries import (
    CATALOG_WHERE_AA, CATALOG_WHERE_NT, FEATURE, LINEAGE_WHERE, ORIGIN, SAMPLE_WHERE, TODAY,
)

SPAN = "collection_end_date - collection_start_date <= 366"
WW = ("(ww_site_id IS NOT NULL OR ww_catchment_population IS NOT NULL "
      "OR ww_collected_by IS NOT NULL OR ww_viral_load IS NOT NULL)")  # fmt: skip

# Helper relations on top of the domain tables.
COMMON = {
    "sg": "SELECT s.*, g.country_name, g.admin1_name, g.admin2_name, g.admin3_name "
    "FROM samples s LEFT JOIN geo_locations g ON g.id = s.geo_location_id",
    "nl": "SELECT l.id AS lineage_id, l.lineage_name, l.lineage_system_id, y.lineage_system_name "
    "FROM lineages l JOIN lineage_systems y ON y.id = l.lineage_system_id",
    "calls": "SELECT c.*, lineage_name, lineage_system_id, lineage_system_name "
    "FROM samples_lineages c JOIN nl ON nl.lineage_id = c.lineage_id",
    # samples with and without lineage, and only those with one
    "sgl": "SELECT sg.*, c.lineage_id, c.abundance, c.is_consensus_call, c.lineage_name, c.lineage_system_name "
    "FROM sg LEFT JOIN calls c ON c.sample_id = sg.id",
    "sgi": "SELECT sg.*, c.lineage_id, c.abundance, c.is_consensus_call, c.lineage_name, c.lineage_system_id, "
    "c.lineage_system_name FROM sg JOIN calls c ON c.sample_id = sg.id",
    "mids": "SELECT id, collection_start_date + cast((collection_end_date - collection_start_date) // 2 AS int) AS mid, "
    f"release_date FROM samples WHERE {SPAN}",
    "ihf": "SELECT *, freq_bin / 20 AS f_lo, (freq_bin + 1) / 20 AS f_hi FROM ih_edges",
}


def sql(body: str, extra: dict[str, str] | None = None, recursive: bool = False) -> str:
    return with_clause(recursive, {**COMMON, **(extra or {})}) + "\n" + body


class Bin:
    """Bin columns of a date expression in one unit."""

    def __init__(self, unit: str):
        self.unit = unit

    @property
    def names(self) -> str:
        return "bin_start, bin_end" if self.unit == "days" else "year, chunk"

    def columns(self, d: str) -> str:
        if self.unit == "month":
            return f"extract(year FROM {d}) AS year, extract(month FROM {d}) AS chunk"
        if self.unit == "week":
            return f"extract(year FROM {d}) AS year, extract(week FROM {d}) AS chunk"
        start = f"(date '{ORIGIN}' + cast(floor(({d} - date '{ORIGIN}') / 14.0) * 14 AS int))"
        return f"{start} AS bin_start, {start} + 14 AS bin_end"

    @property
    def shown(self) -> str:
        """Label and bin columns of a grouped result."""
        if self.unit == "days":
            return ("cast(bin_start AS varchar) || '/' || cast(bin_end AS varchar) AS label, "
                    "cast(bin_start AS varchar) AS bin_start, cast(bin_end AS varchar) AS bin_end")  # fmt: skip
        mark = "W" if self.unit == "week" else ""
        return (f"CASE WHEN year IS NOT NULL THEN concat(year, '-{mark}', lpad(cast(chunk AS varchar), 2, '0')) END "
                "AS label, year, chunk")  # fmt: skip


MONTH, WEEK, DAYS = Bin("month"), Bin("week"), Bin("days")
UNITS = (("", MONTH), ("_week", WEEK), ("_days", DAYS))

_SAMPLE_DATES = ("collection_start_date", "collection_end_date", "release_date", "creation_date",
                 "retraction_detected_date")
_GEO = ("country_name", "admin1_name", "admin2_name", "admin3_name")


def _sample_info(source: str) -> str:
    """Sample rows as the look-up operators show them."""
    dates = ", ".join(f"cast({c} AS varchar) AS {c}" for c in _SAMPLE_DATES)
    geo = ", ".join(f"{c} AS geo_{c}" for c in _GEO)
    return (
        "SELECT id, accession, host, organism, platform, is_retracted, geo_location_id, census_region, "
        f"round(ww_viral_load, 6) AS ww_viral_load, ww_catchment_population, ww_site_id, ww_collected_by, {dates}, {geo} "
        f"FROM {source}"
    )


def _axis(axis: str) -> tuple[str, str, str, str, str, str]:
    if axis == "nt":
        return "alleles", "region, ref_nt, position_nt, alt_nt", "region", "ref_nt", "position_nt", "alt_nt"
    return "amino_acids", "gff_feature, ref_aa, position_aa, alt_aa", "gff_feature", "ref_aa", "position_aa", "alt_aa"


def _extra_columns(axis: str) -> str:
    return ", c.id AS allele_id" if axis == "nt" else ", ref_codon, alt_codon"




def _range_text() -> str:
    """Interval text from exact twentieths."""
    bound = "rtrim(rtrim(printf('%.2f', {}), '0'), '.')"
    low, high = bound.format("f_lo"), bound.format("f_hi")
    return f"concat('[', {low}, ',', {high}, CASE WHEN freq_bin = 19 THEN ']' ELSE ')' END)"


_FREQ = f"{_range_text()} AS alt_freq_range, round(f_lo, 6) AS alt_freq_lower, round(f_hi, 6) AS alt_freq_upper"


def _in_window(low, high) -> str:
    tests = []
    if high is not None:
        tests.append(f"freq_bin <= floor({high} * 20)")
    if low is not None:
        tests.append(f"(freq_bin + 1 > {low} * 20 OR (freq_bin = 19 AND {low} <= 1))")
    return " AND ".join(tests) or "true"


def _quartiles(value: str, names) -> str:
    return ", ".join(f"round(quantile_cont({value}, {p}), 6) AS {n}" for p, n in zip((0.25, 0.5, 0.75), names))


def _binned(scope: str, where: str | None, b: Bin, name: str = "binned") -> dict[str, str]:
    """Distinct samples of a scope with the bin of their mid date."""
    return {
        name: f"SELECT DISTINCT s.id, {b.columns('m.mid')} FROM {scope} s JOIN mids m ON m.id = s.id "
        f"WHERE {f'({where})' if where else 'true'}"
    }


def query_oracles() -> dict[str, str]:
    o: dict[str, str] = {}

    # --- discovery and samples
    for field, table in (("host", "samples"), ("region", "alleles"), ("admin1_name", "geo_locations"),
                         ("lineage_system_name", "lineage_systems")):
        o[f"distinct_values_{field}"] = sql(f"SELECT DISTINCT {field} AS value FROM {table} WHERE {field} IS NOT NULL")
    # worked out by hand for the names NATION_0 to NATION_24 and the search nasion_2: twice the letters in
    # common, "na", "ion_" and maybe the 2, over the letters of both
    o["distinct_values_search"] = sql(
        "SELECT DISTINCT admin1_name AS value, 2.0 * (6 + CASE WHEN substr(admin1_name, 8) LIKE '%2%' THEN 1 ELSE 0 END) "
        "/ (8 + length(admin1_name)) AS score FROM geo_locations WHERE admin1_name IS NOT NULL"
    )
    o["distinct_values"] = sql(
        f"SELECT DISTINCT admin1_name AS value FROM sg WHERE admin1_name IS NOT NULL AND ({SAMPLE_WHERE})"
    )
    o["gff_features"] = sql("SELECT DISTINCT gff_feature FROM amino_acids")
    o["sample_by_id"] = sql(_sample_info("sg") + " WHERE id = 7")
    o["samples"] = sql(_sample_info("sg") + f" WHERE {SAMPLE_WHERE}")
    for axis, where in (("nt", CATALOG_WHERE_NT), ("aa", CATALOG_WHERE_AA)):
        catalog = _axis(axis)[0]
        o[f"samples_by_mutation_{axis}"] = sql(
            _sample_info("sg")
            + f" WHERE id IN (SELECT sample_id FROM cns_edges e JOIN {catalog} c ON c.id = e.change_id WHERE {where})"
        )
        window = _in_window(0.2, 0.55) if axis == "nt" else _in_window(0.9, None)
        o[f"samples_by_variant_{axis}"] = sql(
            _sample_info("sg")
            + f" WHERE id IN (SELECT sample_id FROM ihf e JOIN {catalog} c ON c.id = e.change_id "
            f"WHERE ({where}) AND {window})"
        )
    o["count_samples_by_column"] = sql(
        "SELECT admin1_name, count(*) AS n FROM sg WHERE platform <> '5-LOW' GROUP BY admin1_name"
    )
    o["count_samples_by_column_host"] = sql("SELECT host, count(*) AS n FROM samples GROUP BY host")
    for unit, b in UNITS:
        grouped = f"SELECT {b.shown}, count(*) AS n FROM d GROUP BY {b.names}"
        o[f"count_samples_by_release_date{unit}"] = sql(
            grouped, {"d": f"SELECT {b.columns('release_date')} FROM sg WHERE country_name = 'EUROPE'"}
        )
        o[f"count_samples_by_creation_date{unit}"] = sql(grouped, {"d": f"SELECT {b.columns('creation_date')} FROM sg"})
        o[f"count_samples_by_collection_date{unit}"] = sql(
            grouped, {"d": f"SELECT {b.columns('mid')} FROM sg JOIN mids ON mids.id = sg.id WHERE {SAMPLE_WHERE}"}
        )
        by_lineage = (
            f"SELECT {b.shown}, lineage_name, lineage_system_name, count(*) AS n FROM d "
            f"GROUP BY {b.names}, lineage_name, lineage_system_name"
        )
        names = "lineage_name, lineage_system_name"
        o[f"count_lineages_by_simple_date{unit}"] = sql(
            by_lineage, {"d": f"SELECT {b.columns('release_date')}, {names} FROM sgi WHERE host = 'BUILDING'"}
        )
        o[f"count_lineages_by_collection_date{unit}"] = sql(
            by_lineage,
            {"d": f"SELECT {b.columns('mid')}, {names} FROM sgi JOIN mids ON mids.id = sgi.id WHERE {LINEAGE_WHERE}"},
        )
        o[f"collection_release_lag{unit}"] = sql(
            f"SELECT {b.shown}, {_quartiles('lag', ('lag_q1', 'lag_median', 'lag_q3'))} FROM d GROUP BY {b.names}",
            {"d": f"SELECT {b.columns('mid')}, release_date - mid AS lag FROM mids"},
        )
    o["sample_counts"] = sql(
        f"SELECT {MONTH.shown}, lineage_name, lineage_system_name, count(*) AS n FROM d "
        f"GROUP BY {MONTH.names}, lineage_name, lineage_system_name",
        {
            "d": f"SELECT {MONTH.columns('mid')}, lineage_name, lineage_system_name "
            f"FROM sgi JOIN mids ON mids.id = sgi.id WHERE {SAMPLE_WHERE}"
        },
    )
    for name, where in (("sample_counts_by_lineage", SAMPLE_WHERE), ("sample_counts_by_lineage_all", "true")):
        o[name] = sql(
            "SELECT lineage_system_name, lineage_name, count(DISTINCT sample_id) AS n FROM calls "
            f"WHERE sample_id IN (SELECT id FROM sg WHERE {where}) GROUP BY lineage_system_name, lineage_name"
        )

    # --- intra-host and consensus changes
    for axis, where in (("nt", CATALOG_WHERE_NT), ("aa", CATALOG_WHERE_AA)):
        catalog, columns, *_ = _axis(axis)
        more = _extra_columns(axis)
        key = "region" if axis == "nt" else "position_aa"
        in_samples = f"sample_id IN (SELECT id FROM sg WHERE {SAMPLE_WHERE})"
        in_lineages = f"sample_id IN (SELECT id FROM sgl WHERE {LINEAGE_WHERE})"
        ih = f"FROM ihf e JOIN {catalog} c ON c.id = e.change_id"
        cns = f"FROM cns_edges e JOIN {catalog} c ON c.id = e.change_id"
        o[f"variants_{axis}"] = sql(
            f"SELECT sample_id, {columns}{more}, {_FREQ} {ih} WHERE ({where}) AND {_in_window(0.3, 0.6)}"
        )
        o[f"variants_by_sample_{axis}"] = sql(
            f"SELECT sample_id, {columns}{more}, {_FREQ} {ih} WHERE {in_samples} AND {_in_window(None, 0.5)}"
        )
        counted = "SELECT {key}, count(*) AS n FROM (SELECT DISTINCT change_id, sample_id, {key} {source} WHERE {w}) GROUP BY {key}"
        o[f"count_variants_by_column_{axis}"] = sql(counted.format(key=key, source=ih, w="true"))
        o[f"count_variants_by_column_{axis}_filtered"] = sql(counted.format(key=key, source=ih, w=in_lineages))
        o[f"mutations_{axis}"] = sql(f"SELECT sample_id, {columns}{more} {cns} WHERE {where}")
        o[f"mutations_by_sample_{axis}"] = sql(f"SELECT sample_id, {columns}{more} {cns} WHERE {in_samples}")
        o[f"count_mutations_by_column_{axis}"] = sql(counted.format(key=key, source=cns, w="true"))
        o[f"count_mutations_by_column_{axis}_filtered"] = sql(counted.format(key=key, source=cns, w=in_samples))

        def by_date(edges: str, b: Bin, scope: str, w: str | None, catalog=catalog, columns=columns) -> str:
            return sql(
                f"SELECT {b.shown}, {columns}, count(DISTINCT sample_id) AS n FROM {edges} e "
                f"JOIN {catalog} c ON c.id = e.change_id JOIN binned s ON s.id = e.sample_id "
                f"GROUP BY {b.names}, {columns}",
                _binned(scope, w, b),
            )

        o[f"count_variants_by_collection_date_{axis}"] = by_date(
            "ih_edges", MONTH, "sgl", LINEAGE_WHERE if axis == "aa" else None
        )
        o[f"count_mutations_by_collection_date_{axis}"] = by_date(
            "cns_edges", MONTH, "sgl", "host = 'BUILDING'" if axis == "aa" else None
        )

        def frequency(b: Bin, w: str | None, catalog=catalog, columns=columns) -> str:
            names = ("alt_freq_q1", "alt_freq_median", "alt_freq_q3")
            return sql(
                f"SELECT {b.shown}, {columns}, count(DISTINCT sample_id) AS n, "
                f"{_quartiles('(freq_bin + 0.5) / 20', names)} FROM ih_edges e "
                f"JOIN {catalog} c ON c.id = e.change_id JOIN binned s ON s.id = e.sample_id "
                f"GROUP BY {b.names}, {columns}",
                _binned("sgl", w, b),
            )

        o[f"variant_frequency_by_collection_date_{axis}"] = frequency(MONTH, None)
        if axis == "aa":
            o["count_variants_by_collection_date_aa_week"] = by_date("ih_edges", WEEK, "sgl", SAMPLE_WHERE)
            o["variant_frequency_by_collection_date_aa_week"] = frequency(WEEK, SAMPLE_WHERE)

        feature, ref, position, alt = columns.split(", ")[0], *_axis(axis)[3:6]

        def incidence(w: str, keep_refs: str, catalog=catalog, columns=columns) -> str:
            members = (
                "SELECT DISTINCT s.id FROM samples s JOIN calls c ON c.sample_id = s.id "
                f"WHERE lineage_name = 'N17' AND lineage_system_name = 'consensus' AND ({w})"
            )
            return sql(
                f"SELECT {columns}, n AS count, round(n / total, 6) AS prevalence, total AS sample_count FROM ("
                f"SELECT e.change_id, count(*) AS n FROM cns_edges e JOIN members m ON m.id = e.sample_id GROUP BY e.change_id) "
                f"JOIN {catalog} c ON c.id = change_id, (SELECT count(*) AS total FROM members) "
                f"WHERE {keep_refs} AND n * 100 >= total",
                {"members": members},
            )

        o[f"mutation_incidence_{axis}"] = incidence("true", f"{ref} <> {alt}")
        if axis == "aa":
            o["mutation_incidence_reference"] = incidence("platform <> '5-LOW'", "true")

        change = ("Brand-17", "C", 28, "A") if axis == "nt" else ("STANDARD", "A", 29, "D")
        one = f"{feature} = '{change[0]}' AND {ref} = '{change[1]}' AND {position} = {change[2]} AND {alt} = '{change[3]}'"
        o[f"variant_sample_frequency_{axis}"] = sql(
            f"SELECT sample_id, accession, {_FREQ} {ih} JOIN samples s ON s.id = e.sample_id WHERE {one}"
        )
        shown = "e.change_id" if axis == "aa" else "cast(NULL AS bigint)"
        o[f"mutation_sample_count_{axis}"] = sql(
            f"SELECT {shown} AS amino_sub_id, count(*) AS sample_count {cns} WHERE {one} GROUP BY e.change_id"
        )
        w = "true" if axis == "nt" else "lineage_name <> 'N3' AND host <> 'BUILDING'"
        o[f"mutation_count_by_date_and_lineage_{axis}"] = sql(
            f"SELECT {MONTH.shown}, {columns}, lineage_name, count(DISTINCT sample_id) AS n FROM d "
            f"GROUP BY {MONTH.names}, {columns}, lineage_name",
            {
                "d": f"SELECT {MONTH.columns('mid')}, {columns}, lineage_name, e.sample_id {cns} "
                f"JOIN samples s ON s.id = e.sample_id JOIN mids m ON m.id = s.id JOIN calls l ON l.sample_id = s.id "
                f"WHERE {feature} = '{change[0]}' AND {position} = {change[2]} AND {alt} = '{change[3]}' AND ({w})"
            },
        )
    o["count_variants_by_freq_range_aa"] = sql(
        f"SELECT {_range_text()} AS alt_freq_range, count(*) AS n FROM ihf GROUP BY freq_bin, f_lo, f_hi"
    )
    o["count_mutations_by_collection_date_aa_days"] = sql(
        f"SELECT {DAYS.shown}, gff_feature, ref_aa, position_aa, alt_aa, count(DISTINCT sample_id) AS n FROM d "
        f"GROUP BY {DAYS.names}, gff_feature, ref_aa, position_aa, alt_aa",
        {
            "d": f"SELECT {DAYS.columns('mid')}, gff_feature, ref_aa, position_aa, alt_aa, e.sample_id "
            "FROM cns_edges e JOIN amino_acids c ON c.id = e.change_id JOIN sg ON sg.id = e.sample_id "
            "JOIN mids m ON m.id = sg.id WHERE position_aa < 20 AND country_name = 'ASIA'"
        },
    )

    def by_score(edges: str, metric: str, refs: bool, where: str) -> str:
        return sql(
            "SELECT ref_aa, position_aa, alt_aa, round(v.value, 6) AS pheno_value, count(DISTINCT sample_id) AS count "
            f"FROM {edges} e JOIN amino_acids c ON c.id = e.change_id "
            "JOIN phenotype_metric_values v ON v.amino_acid_id = c.id "
            "JOIN phenotype_metrics p ON p.id = v.phenotype_metric_id "
            f"WHERE gff_feature = '{FEATURE}' AND phenotype_metric_name = '{metric}' AND {'true' if refs else 'ref_aa <> alt_aa'} "
            f"AND sample_id IN (SELECT id FROM sg WHERE {where}) GROUP BY ref_aa, position_aa, alt_aa, v.value"
        )

    o["variant_counts_by_score"] = by_score("ih_edges", "signed_size", True, "true")
    o["variant_counts_by_score_filtered"] = by_score("ih_edges", "price", False, SAMPLE_WHERE)
    o["mutation_counts_by_score"] = by_score("cns_edges", "signed_size", False, "true")
    o["mutation_counts_by_score_filtered"] = by_score("cns_edges", "signed_size", True, SAMPLE_WHERE)

    seen = {
        "members": "SELECT DISTINCT s.id, collection_start_date FROM samples s JOIN calls c ON c.sample_id = s.id "
        "WHERE lineage_name = 'N3' AND lineage_system_name = 'consensus' "
        "AND collection_end_date - collection_start_date <= 30",
        **{
            name: f"SELECT min(collection_start_date) AS d, ref_aa, position_aa, alt_aa, gff_feature FROM {edges} e "
            "JOIN members m ON m.id = e.sample_id JOIN amino_acids c ON c.id = e.change_id "
            "GROUP BY ref_aa, position_aa, alt_aa, gff_feature"
            for name, edges in (("fm", "cns_edges"), ("fv", "ih_edges"))
        },
    }
    for name, test, lag in (
        ("mutations_before_variants", "fm.d < fv.d", "fv.d - fm.d"),
        ("variants_before_mutations", "fv.d < fm.d", "fm.d - fv.d"),
    ):
        o[name] = sql(
            "SELECT cast(fv.d AS varchar) AS variants_start_date, cast(fm.d AS varchar) AS mutations_start_date, "
            f"{lag} AS lag, ref_aa AS ref, position_aa AS pos, alt_aa AS alt, gff_feature "
            f"FROM fm JOIN fv USING (ref_aa, position_aa, alt_aa, gff_feature) WHERE {test}",
            seen,
        )

    # --- lineages
    o["lineages_in_system"] = sql("SELECT * FROM nl WHERE lineage_system_name = 'demixed'")
    o["abundances"] = sql(
        "SELECT lineage_id, lineage_name, lineage_system_id, lineage_system_name, id AS sample_id, accession, "
        f"round(abundance, 6) AS abundance FROM sgi WHERE NOT is_consensus_call AND ({SAMPLE_WHERE})"
    )
    five = (
        "count(*) AS sample_count, round(min(abundance), 6) AS abundance_min, "
        + _quartiles("abundance", ("abundance_q1", "abundance_median", "abundance_q3"))
        + ", round(max(abundance), 6) AS abundance_max"
    )
    for name, w in (("abundance_summaries", "true"), ("abundance_summaries_filtered", LINEAGE_WHERE)):
        o[name] = sql(
            f"SELECT lineage_name, lineage_system_name, {five} FROM sgi WHERE NOT is_consensus_call AND ({w}) "
            "GROUP BY lineage_name, lineage_system_name"
        )
    for name, b, w in (
        ("abundance_summaries_by_collection_date", MONTH, "true"),
        ("abundance_summaries_by_collection_date_week", WEEK, SAMPLE_WHERE),
    ):
        o[name] = sql(
            f"SELECT {b.shown}, lineage_name, lineage_system_name, {five} FROM d "
            f"GROUP BY {b.names}, lineage_name, lineage_system_name",
            {
                "d": f"SELECT {b.columns('mid')}, lineage_name, lineage_system_name, abundance FROM sgi "
                f"JOIN mids m ON m.id = sgi.id WHERE NOT is_consensus_call AND ({w})"
            },
        )

    def over_time(b: Bin, w: str, recent: str, lineage: str) -> str:
        return sql(
            f"SELECT {b.shown}, lineage_name, lineage_system_name, n AS count, cast(total AS bigint) AS total, "
            f"round(n / total, 6) AS prevalence FROM (SELECT *, sum(n) OVER (PARTITION BY {b.names}) AS total FROM g) "
            f"WHERE {lineage}",
            {
                "d": f"SELECT {b.columns('mid')}, lineage_name, lineage_system_name FROM sgi JOIN mids m ON m.id = sgi.id "
                f"WHERE is_consensus_call AND ({w}) AND {recent}",
                "g": f"SELECT {b.names}, lineage_name, lineage_system_name, count(*) AS n FROM d "
                f"GROUP BY {b.names}, lineage_name, lineage_system_name",
            },
        )

    o["lineage_counts_over_time"] = over_time(MONTH, "true", "true", "true")
    o["lineage_counts_over_time_days"] = over_time(DAYS, "true", "true", "true")
    o["lineage_counts_over_time_recent"] = over_time(
        WEEK, "host <> 'BUILDING'", f"mid >= date '{TODAY}' - 400", "lineage_name = 'N3'"
    )
    for name, w in (("mutation_profile", "true"), ("mutation_profile_filtered", "host = 'BUILDING'")):
        o[name] = sql(
            "SELECT region, ref_nt, alt_nt, count, cast(sum(count) OVER (PARTITION BY region) AS bigint) AS total, "
            "round(count / sum(count) OVER (PARTITION BY region), 6) AS prevalence FROM g",
            {
                "g": "SELECT region, ref_nt, alt_nt, count(*) AS count FROM cns_edges e JOIN alleles a ON a.id = e.change_id "
                "WHERE ref_nt IN ('A', 'C', 'G', 'T') AND alt_nt IN ('A', 'C', 'G', 'T') AND e.sample_id IN ("
                "SELECT s.id FROM samples s JOIN calls c ON c.sample_id = s.id WHERE lineage_name = 'N3' "
                f"AND lineage_system_name = 'consensus' AND ({w})) GROUP BY region, ref_nt, alt_nt"
            },
        )
    closure = {
        "deep": "SELECT parent_id, child_id FROM lineages_immediate_children UNION "
        "SELECT d.parent_id, c.child_id FROM deep d JOIN lineages_immediate_children c ON d.child_id = c.parent_id"
    }
    o["lineage_descendants"] = sql("SELECT DISTINCT parent_id, child_id FROM deep", closure, recursive=True)

    # --- wastewater
    o["ww_abundances_by_sample"] = sql(
        "SELECT accession, admin1_name, ww_collected_by, ww_site_id, lineage_name, round(abundance, 6) AS abundance, "
        "round(ww_viral_load, 6) AS ww_viral_load, ww_catchment_population, "
        f"cast(collection_start_date AS varchar) AS collection_start_date FROM sgi WHERE {WW} AND country_name = 'ASIA'"
    )

    def averages(geo: str, picked: str, name: str, w: str = "true", extra: dict[str, str] | None = None) -> str:
        keys = [k.strip() for k in geo.split(",")]
        on = " AND ".join(f"l.{k} = t.{k}" for k in ["week_start", *keys])
        admin1 = "l.admin1_name" if "admin1_name" in keys else "cast(NULL AS varchar)"
        return sql(
            "SELECT extract(year FROM l.week_start) AS year, extract(week FROM l.week_start) AS chunk, "
            "extract(year FROM l.week_start) * 100 + extract(week FROM l.week_start) AS epiweek, "
            "cast(l.week_start AS varchar) AS week_start, cast(l.week_start + 6 AS varchar) AS week_end, "
            f"l.lineage_name, l.census_region, {admin1} AS geo_admin1_name, l.n AS sample_count, "
            "round(mean_viral_load, 6) AS mean_viral_load, round(mean_catchment_size, 6) AS mean_catchment_size, "
            f"round(l.weighted / t.weighted, 6) AS mean_lineage_prevalence FROM l JOIN t ON {on}",
            {
                **(extra or {}),
                "base": "SELECT cast(date_trunc('week', mid) AS date) AS week_start, lineage_id, lineage_name, admin1_name, "
                "census_region, abundance * ww_catchment_population AS weighted, ww_viral_load, ww_catchment_population "
                f"FROM sgi JOIN mids m ON m.id = sgi.id WHERE {WW} AND ({w})",
                "t": f"SELECT week_start, {geo}, sum(weighted) AS weighted, avg(ww_viral_load) AS mean_viral_load, "
                f"avg(ww_catchment_population) AS mean_catchment_size FROM base GROUP BY week_start, {geo}",
                "l": f"SELECT week_start, {geo}, {name} AS lineage_name, sum(weighted) AS weighted, count(*) AS n "
                f"FROM base WHERE {picked} GROUP BY week_start, {geo}, {name}",
            },
            recursive=extra is not None,
        )

    o["ww_average_abundance"] = averages("admin1_name, census_region", "true", "lineage_name")
    o["ww_average_abundance_census"] = averages("census_region", "lineage_name = 'N3'", "lineage_name")
    o["ww_average_abundance_wildcard"] = averages(
        "admin1_name, census_region",
        "lineage_id IN (SELECT id FROM lineages WHERE lineage_name = 'R2' UNION "
        "SELECT child_id FROM deep JOIN lineages r ON r.id = parent_id WHERE r.lineage_name = 'R2')",
        "'R2*'",
        "host <> 'BUILDING'",
        closure,
    )
    o["ww_lineage_counts"] = sql(
        f"SELECT lineage_name, count(*) AS n FROM sgl WHERE abundance IS NOT NULL AND {WW} "
        "AND (country_name = 'ASIA' OR host = 'BUILDING') GROUP BY lineage_name"
    )
    for name, column, w in (("ww_sample_counts", "admin1_name", "true"), ("ww_sample_counts_site", "ww_site_id", SAMPLE_WHERE)):
        o[name] = sql(
            f"SELECT {column}, count(*) AS n FROM sgl WHERE abundance IS NOT NULL AND {WW} AND ({w}) GROUP BY {column}"
        )
    latest = f"{WW} AND (country_name = 'ASIA' OR host = 'BUILDING')"
    o["ww_latest_samples"] = sql(
        _sample_info("sg") + f" WHERE {latest} AND collection_start_date = "
        f"(SELECT max(collection_start_date) FROM sg WHERE {latest})"
    )

    # --- phenotype and annotations
    o["phenotype_metrics"] = sql(
        "SELECT id, phenotype_metric_name AS name, phenotype_metric_assay_type AS assay_type FROM phenotype_metrics"
    )
    scored = (
        "SELECT v.amino_acid_id, v.value FROM phenotype_metric_values v JOIN phenotype_metrics p "
        "ON p.id = v.phenotype_metric_id WHERE phenotype_metric_name = '{}'"
    )
    for name, metric in (("metric_min_max", "price"), ("metric_min_max_unknown", "no such metric")):
        o[name] = sql(
            "SELECT round(min(value), 6) AS min_value, round(max(value), 6) AS max_value FROM sc",
            {"sc": scored.format(metric)},
        )
    for name, edges, metric, q in (
        ("metric_quantile_mutations", "cns_edges", "signed_size", 0.9),
        ("metric_quantile_variants", "ih_edges", "price", 0.25),
    ):
        o[name] = sql(
            f"SELECT cast({q} AS double) AS quantile, round(min(value), 6) AS phenotype_metric_value FROM ("
            "SELECT value, row_number() OVER (ORDER BY value) AS r, count(*) OVER () AS n FROM sc "
            f"WHERE value <> 0 AND amino_acid_id IN (SELECT change_id FROM {edges})) WHERE r >= ceil(n * {q})",
            {"sc": scored.format(metric)},
        )
    o["metric_sum_cache"] = sql(
        "SELECT sample_id, phenotype_metric_id, round(sum(value), 6) AS pmv_value_sum, count(*) AS n_scored_mutations "
        "FROM phenotype_metric_values v JOIN cns_edges e ON e.change_id = v.amino_acid_id JOIN samples s ON s.id = e.sample_id "
        "WHERE collection_start_date IS NOT NULL AND collection_end_date IS NOT NULL GROUP BY sample_id, phenotype_metric_id"
    )
    for unit, b, w in (("", MONTH, None), ("_week", WEEK, SAMPLE_WHERE)):
        binned = _binned("sgi", w, b)
        for kind, edges, window in (
            ("mutations", "cns_edges", "true"),
            ("variants", "ih_edges", _in_window(0.25, 0.75)),
        ):
            o[f"scored_{kind}_by_date{unit}"] = sql(
                f"SELECT {b.shown}, cast(sum(CASE WHEN value >= 10 THEN 1 ELSE 0 END) AS bigint) AS n_gte, count(*) AS n FROM ("
                f"SELECT DISTINCT {b.names}, amino_acid_id, value FROM sc JOIN {edges} e ON e.change_id = amino_acid_id "
                f"JOIN binned s ON s.id = e.sample_id WHERE {window}) GROUP BY {b.names}",
                {**binned, "sc": scored.format("signed_size")},
            )
            load = _quartiles("load", ("aggregate_value_q1", "aggregate_value_median", "aggregate_value_q3"))
            number = _quartiles("n_aa", ("n_aa_q1", "n_aa_median", "n_aa_q3"))
            o[f"metric_load_{kind}_by_date{unit}"] = sql(
                f"SELECT {b.shown}, {load}, {number} FROM per GROUP BY {b.names}",
                {
                    **binned,
                    "sc": scored.format("price"),
                    "per": f"SELECT {b.names}, s.id, sum(value) AS load, count(*) AS n_aa FROM ("
                    f"SELECT DISTINCT change_id, sample_id FROM {edges}) e JOIN sc ON sc.amino_acid_id = e.change_id "
                    f"JOIN binned s ON s.id = e.sample_id GROUP BY {b.names}, s.id",
                },
            )
            annotated = (
                "SELECT m.amino_acid_id, bool_or(a.effect_detail = 'Brand#12') AS hit FROM annotations_amino_acids m "
                "JOIN annotations a ON a.annotation_id = m.annotation_id "
                "JOIN annotations_papers p ON p.annotation_id = a.annotation_id GROUP BY m.amino_acid_id"
            )
            o[f"annotation_proportion_{kind}_by_date{unit}"] = sql(
                f"SELECT {b.shown}, count(*) FILTER (WHERE hit) AS n, count(*) AS n_total, "
                f"round(count(*) FILTER (WHERE hit) / count(*), 6) AS proportion FROM ("
                f"SELECT DISTINCT {b.names}, amino_acid_id, hit FROM ann JOIN {edges} e ON e.change_id = amino_acid_id "
                f"JOIN binned s ON s.id = e.sample_id) GROUP BY {b.names}",
                {**binned, "ann": annotated},
            )
    o["annotation_effects"] = sql("SELECT DISTINCT detail FROM effects")
    o["annotation_id_sets"] = sql(
        "SELECT DISTINCT m.annotation_id, m.amino_acid_id FROM annotations_amino_acids m "
        "JOIN annotations a ON a.annotation_id = m.annotation_id WHERE effect_detail = 'Brand#12'"
    )
    for name, edges, w in (
        ("annotated_positions_mutations", "cns_edges", "true"),
        ("annotated_positions_variants", "ih_edges", SAMPLE_WHERE),
    ):
        o[name] = sql(
            "SELECT gff_feature, ref_aa, position_aa, alt_aa, count(*) AS count FROM ("
            f"SELECT DISTINCT change_id, sample_id FROM {edges} WHERE sample_id IN (SELECT id FROM sgi WHERE {w})) e "
            "JOIN amino_acids c ON c.id = e.change_id WHERE c.id IN (SELECT m.amino_acid_id FROM annotations_amino_acids m "
            "JOIN annotations a ON a.annotation_id = m.annotation_id JOIN annotations_papers p "
            "ON p.annotation_id = a.annotation_id WHERE effect_detail = 'Brand#12') "
            "GROUP BY gff_feature, ref_aa, position_aa, alt_aa"
        )

    # --- the same rows by another route
    for name, same in (
        ("sample_counts_column", "count_samples_by_column"),
        ("sample_counts_release_date", "count_samples_by_release_date"),
        ("sample_counts_collection_date", "count_samples_by_collection_date"),
        ("sample_counts_lineage", "sample_counts_by_lineage"),
        ("sample_counts_lineage_release_date", "count_lineages_by_simple_date"),
        ("metric_load_mutations_by_date_cached", "metric_load_mutations_by_date"),
    ):
        o[name] = o[same]
    for name in o:
        if name in WHOLE_EDGES:
            o[name] = on_all_edges(o[name])
        elif name.endswith("_nt") or "_nt_" in name or name.startswith("mutation_profile"):
            o[name] = on_nucleotides(o[name])
    return o
