"""Raw records for the ingest operators, again as projections that Spark and DuckDB both accept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from virosieve.workload.binding import frame, with_clause


def codon(x: str) -> str:
    """Three bases from a number: N now and then, and a gap that makes the codon unreadable."""
    return (
        f"concat(substr('ACGTN', cast(({x}) % 5 AS int) + 1, 1), "
        f"substr('ACGTN', cast(floor(({x}) / 5) AS int) % 5 + 1, 1), "
        f"substr('ACGT-', cast(floor(({x}) / 25) AS int) % 5 + 1, 1))"
    )


def base(x: str) -> str:
    return f"substr('ACGT', cast(({x}) % 4 AS int) + 1, 1)"


def residue(x: str) -> str:
    return f"substr('ADKS', cast(({x}) % 4 AS int) + 1, 1)"


_QUARTER = "cast(floor(p_partkey / 4) AS int)"
_ACCESSION = "concat(CASE WHEN l_orderkey % 41 = 0 THEN 'U' ELSE 'S' END, cast(l_orderkey AS string))"
_ALT_CODON = codon("p_partkey * 7 + 3")
_FREQ = "cast((l_quantity - 1) / 49 AS decimal(20,10))"
_DEPTH = "cast(floor(l_extendedprice / 1000) AS int)"

RAW = {
    # --- change records
    "raw_mutations": f"""
  SELECT {_ACCESSION} AS accession, replace(p_brand, '#', '-') AS region, p_size AS position_nt,
         CASE WHEN (l_orderkey + l_partkey) % 53 <> 0
              THEN {base("p_partkey + CASE WHEN l_orderkey % 19 = 0 THEN 1 ELSE 0 END")} END AS ref_nt,
         {base(_QUARTER)} AS alt_nt, CASE WHEN p_partkey % 11 <> 0 THEN p_type END AS gff_feature,
         {codon("p_partkey + CASE WHEN l_orderkey % 23 = 0 THEN 1 ELSE 0 END")} AS ref_codon, {_ALT_CODON} AS alt_codon,
         {residue("p_partkey + CASE WHEN l_orderkey % 29 = 0 THEN 1 ELSE 0 END")} AS ref_aa, {residue(_QUARTER)} AS alt_aa,
         p_size AS position_aa
  FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_returnflag <> 'R'""",
    "raw_ih_nt": f"""
  SELECT {_ACCESSION} AS accession, replace(p_brand, '#', '-') AS region, p_size AS position_nt,
         {base("p_partkey")} AS ref_nt, {base(_QUARTER)} AS alt_nt, {_FREQ} AS gapped_freq,
         CASE WHEN l_orderkey % 31 <> 0 THEN {_DEPTH} END AS gapped_dp
  FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_returnflag = 'R'""",
    "raw_ih_codons": f"""
  SELECT {_ACCESSION} AS accession, p_type AS gff_feature, p_size AS position_aa, {codon("p_partkey")} AS ref_codon,
         {_ALT_CODON} AS alt_codon, 100 AS ref_dp, {_DEPTH} AS alt_dp, cast({_FREQ} AS double) AS alt_freq
  FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_returnflag = 'R'""",
    # records as they are after the filters
    "ok_mutations": """
  SELECT * FROM raw_mutations WHERE accession IN (SELECT accession FROM samples) AND ref_nt IS NOT NULL""",
    "ok_ih_nt": """
  SELECT * FROM raw_ih_nt WHERE accession IN (SELECT accession FROM samples) AND alt_nt <> ref_nt
     AND gapped_freq >= 0.02 AND (gapped_dp >= 10 OR gapped_dp IS NULL)""",
    "ok_ih_codons": """
  SELECT * FROM raw_ih_codons WHERE accession IN (SELECT accession FROM samples) AND alt_codon <> ref_codon
     AND alt_freq >= 0.02 AND alt_dp >= 10""",
    # catalogs: a partly filled one before the load, and a full one
    "known_alleles": """
  SELECT min(id) AS id, region, position_nt, min(ref_nt) AS ref_nt, alt_nt FROM alleles WHERE id % 2 = 0
  GROUP BY region, position_nt, alt_nt""",
    "full_alleles": """
  SELECT min(id) AS id, region, position_nt, min(ref_nt) AS ref_nt, alt_nt FROM alleles GROUP BY region, position_nt, alt_nt""",
    "full_amino_acids": f"""
  SELECT min(p_partkey) AS id, p_type AS gff_feature, p_size AS position_aa, {residue(_QUARTER)} AS alt_aa, {_ALT_CODON} AS alt_codon,
         min({residue("p_partkey")}) AS ref_aa, min({codon("p_partkey")}) AS ref_codon
  FROM part GROUP BY p_type, p_size, {residue(_QUARTER)}, {_ALT_CODON}""",
    "known_amino_acids": """
  SELECT * FROM full_amino_acids WHERE id % 3 = 0""",
    "stored_edges": """
  SELECT change_id, sample_id FROM cns_edges WHERE sample_id % 2 = 0""",
    "incoming_edges": """
  SELECT change_id, sample_id FROM cns_edges WHERE sample_id % 3 = 0 OR sample_id % 2 = 1""",
    # --- text cells
    "raw_dates": """
  SELECT o_orderkey AS id, o_orderkey % 9 AS kind, cast(o_orderdate AS date) AS d,
         cast(extract(year FROM o_orderdate) AS string) AS y, cast(extract(month FROM o_orderdate) AS string) AS m,
         cast(extract(day FROM o_orderdate) AS string) AS dd FROM orders""",
    "date_texts": """
  SELECT id, kind, d, CASE kind WHEN 0 THEN y WHEN 1 THEN concat(y, '-', m) WHEN 2 THEN concat(y, '-', m, '-', dd)
         WHEN 3 THEN concat(y, '-', lpad(m, 2, '0'), '-', lpad(dd, 2, '0'), 'T08:15:00Z')
         WHEN 4 THEN concat(y, '-', m, '-', dd, ' 08:15/', y, '-12') WHEN 5 THEN concat(y, '-0') WHEN 6 THEN concat(y, '-', m, '-', dd, '/')
         WHEN 7 THEN concat(y, '-', m, '-', dd, '/', cast(cast(y AS int) + 1 AS string)) END AS collection_date
  FROM raw_dates""",
    "raw_cells": """
  SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 3 = 0 THEN '' ELSE cast(l_quantity / 2 AS string) END AS number_text,
         CASE l_linenumber % 4 WHEN 0 THEN 'TRUE' WHEN 1 THEN 'False' WHEN 2 THEN '' ELSE 'true' END AS flag_text
  FROM lineitem""",
    "raw_features": """
  SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN concat('HA:cds-', p_type, '.1') WHEN 1 THEN concat('cds-', p_type)
         WHEN 2 THEN concat('HA:', p_type) ELSE p_type END AS feature FROM part""",
    "raw_change_names": """
  SELECT id, CASE WHEN id % 7 = 0 THEN concat(gff_feature, ' ', ref_aa, cast(position_aa AS string), alt_aa)
         WHEN id % 11 = 0 THEN concat(gff_feature, ':', ref_aa, cast(position_aa AS string))
         ELSE concat(gff_feature, ':', ref_aa, cast(position_aa AS string), alt_aa) END AS name FROM amino_acids""",
    "raw_accessions": """
  SELECT o_orderkey AS id, concat('SRR', cast(29182400 + o_orderkey % 120 AS string)) AS accession FROM orders""",
    "raw_places": """
  SELECT c_custkey AS id, CASE c_custkey % 5 WHEN 0 THEN concat(r_name, '/', n_name, '/', c_mktsegment, '/x')
         WHEN 1 THEN concat(r_name, ' / ', n_name, ' ') WHEN 2 THEN r_name WHEN 3 THEN concat(r_name, '/', n_name, '/a/b/c') END AS geo_location
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "place_tuples": """
  SELECT c_custkey AS customer, r_name AS country_name, n_name AS admin1_name,
         CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END AS admin2_name, cast(NULL AS string) AS admin3_name
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "known_places": """
  SELECT * FROM geo_locations WHERE id % 2 = 0""",
    # --- samples, scores, calls
    "stored_samples": """
  SELECT id, accession, host, organism, platform, collection_start_date, collection_end_date FROM samples WHERE id % 3 <> 0""",
    "incoming_samples": """
  SELECT accession, concat('new ', host) AS host, CASE WHEN id % 4 = 0 THEN organism END AS organism,
         collection_start_date, collection_end_date FROM samples WHERE id % 2 = 0 OR id % 3 = 0""",
    "raw_scores": """
  SELECT gff_feature, position_aa, ref_aa, alt_aa, CASE WHEN id % 2 = 0 THEN 'price' ELSE 'novel' END AS phenotype_metric_name,
         'DMS' AS phenotype_metric_assay_type, cast(id % 100 AS double) AS value, id AS input_order FROM amino_acids WHERE id % 3 <> 0
  UNION ALL SELECT 'nowhere', position_aa, ref_aa, alt_aa, 'unseen', 'DMS', 1.0, id FROM amino_acids WHERE id % 3 = 0""",
    "raw_calls": """
  SELECT concat(CASE WHEN o_orderkey % 37 = 0 THEN 'U' ELSE 'S' END, cast(o_orderkey AS string)) AS accession,
         CASE WHEN o_custkey % 10 = 0 THEN 'Not assigned: low coverage' WHEN o_custkey % 3 = 0 THEN concat('N', cast(c_nationkey AS string))
              ELSE concat('G', cast(c_nationkey AS string)) END AS lineage_name, o_custkey AS input_order
  FROM orders JOIN customer ON o_custkey = c_custkey
  UNION ALL SELECT concat('S', cast(o_orderkey AS string)), concat('late', cast(o_orderkey % 10 AS string)), 100000000 + o_orderkey
  FROM orders WHERE o_orderkey % 2 = 0""",
    "raw_abundances": """
  SELECT concat('S', cast(l_orderkey AS string)) AS accession,
         CASE WHEN l_suppkey % 4 = 0 THEN concat('Q', cast(l_suppkey AS string))
              ELSE concat('R', cast(n_regionkey AS string), '.', cast(n_nationkey AS string), '.', cast(s_suppkey AS string)) END AS lineage_name,
         max(l_discount) AS abundance, l_linenumber AS input_order
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
  GROUP BY l_orderkey, l_suppkey, s_suppkey, n_regionkey, n_nationkey, l_linenumber""",
    "raw_hierarchy": """
  SELECT concat('R', cast(n_regionkey AS string)) AS parent_name, concat('R', cast(n_regionkey AS string), '.', cast(n_nationkey AS string), '*') AS child_name
  FROM nation WHERE n_nationkey % 5 <> 4
  UNION ALL SELECT concat('R', cast(n_regionkey AS string), '.', cast(n_nationkey AS string)),
            concat('R', cast(n_regionkey AS string), '.', cast(n_nationkey AS string), '.', cast(s_suppkey AS string))
            FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_suppkey % 3 <> 0
  UNION ALL SELECT concat('Z', cast(s_suppkey % 7 AS string)), concat('Z', cast(s_suppkey % 7 AS string), '.', cast(s_suppkey AS string)) FROM supplier""",
    "raw_markers": """
  SELECT concat(CASE WHEN p_partkey % 9 = 0 THEN 'XX' ELSE p_type END, ':', ref_aa, cast(position_aa AS string), alt_aa) AS aa_change,
         concat('effect of ', p_brand) AS effect_detail, concat('title', cast(p_size % 10 AS string)) AS title,
         concat('author', cast(p_size % 20 AS string)) AS authors, cast(2000 + p_size % 10 AS bigint) AS publication_year,
         cast(floor(p_partkey / 3) AS bigint) % 300 AS marker_id
  FROM part JOIN amino_acids ON id = p_partkey
  UNION ALL SELECT concat(p_type, ':', ref_aa, cast(position_aa AS string), alt_aa), concat('effect of ', p_brand), 'again', 'someone', 2020, 1000 + p_size
  FROM part JOIN amino_acids ON id = p_partkey WHERE p_partkey % 10 = 0""",
    "known_annotations": """
  SELECT concat('effect of ', p_brand) AS effect_detail, p_partkey AS annotation_id FROM part WHERE p_partkey % 20 = 0""",
    "known_annotation_members": """
  SELECT DISTINCT p.p_partkey AS annotation_id, b.id AS amino_acid_id FROM part p JOIN amino_acids a ON a.id = p.p_partkey
  JOIN amino_acids b ON b.gff_feature = a.gff_feature AND b.position_aa = a.position_aa AND b.ref_aa = a.ref_aa AND b.alt_aa = a.alt_aa
  WHERE p.p_partkey % 20 = 0""",
    # --- records as the source files hold them, all cells text
    "file_runs": """
  SELECT accession, 'WGS' AS assay_type, cast(id % 300 AS string) AS avg_spot_length,
         CASE WHEN id % 71 = 0 THEN '12.5' ELSE cast(id * 100 AS string) END AS bases, concat('PRJ', cast(id % 20 AS string)) AS bio_project,
         concat('SAM', cast(id AS string)) AS bio_sample, CASE WHEN id % 43 <> 0 THEN 'model' END AS bio_sample_model,
         cast(NULL AS string) AS bio_sample_accession, 'center, the "first"' AS center_name, cast(collection_start_date AS string) AS collection_date,
         concat('EX', cast(id AS string)) AS experiment, CASE WHEN id % 5 = 0 THEN concat(census_region, '/a/b') WHEN id % 7 <> 0
              THEN concat(census_region, '/', cast(geo_location_id AS string), '//') END AS geo_loc_name, host, 'instrument' AS instrument,
         '' AS isolate, 'lib' AS library_name, 'PAIRED' AS library_layout, 'PCR' AS library_selection, 'VIRAL' AS library_source,
         organism, platform, concat(cast(release_date AS string), 'T10:20:30Z') AS release_date, cast(creation_date AS string) AS creation_date,
         '1' AS version, accession AS sample_name, 'study' AS sra_study, cast(NULL AS string) AS serotype, 'air' AS isolation_source,
         CASE WHEN is_retracted THEN 'True' ELSE 'false' END AS is_retracted,
         concat(cast(retraction_detected_date AS string), 'T00:00:00') AS retraction_detected_date FROM samples""",
    "file_sd": """
  SELECT accession, host, cast(collection_start_date AS string) AS collection_date,
         concat(census_region, ' / ', cast(geo_location_id AS string)) AS geo_location FROM samples""",
    "file_bulk": """
  SELECT accession, 'PRJ' AS bio_project, concat('SAM', cast(id AS string)) AS bio_sample, host, cast(NULL AS string) AS isolate, organism,
         'sewage' AS isolation_source, concat(cast(extract(year FROM collection_start_date) AS string), '-', cast(extract(month FROM collection_start_date) AS string)) AS collection_date,
         concat(census_region, ':', cast(geo_location_id AS string), ':c') AS geo_location, census_region, cast(id AS string) AS bases,
         cast(ww_viral_load AS string) AS ww_viral_load, cast(ww_catchment_population AS string) AS ww_catchment_population,
         ww_site_id, ww_collected_by FROM samples""",
    "file_ih_nt": """
  SELECT region, position_nt, ref_nt, alt_nt, 10 AS ref_dp, 5 AS ref_rv, 30.5 AS ref_qual, gapped_dp AS alt_dp, 2 AS alt_rv, 31.5 AS alt_qual,
         gapped_freq AS alt_freq, 100 AS total_dp, 0.25 AS pval, true AS pass_qc, cast(NULL AS string) AS gff_feature, cast(NULL AS string) AS ref_codon,
         cast(NULL AS string) AS ref_aa, cast(NULL AS string) AS alt_codon, cast(NULL AS string) AS alt_aa, cast(NULL AS int) AS position_aa,
         gapped_freq, gapped_dp, false AS flagged_pos, false AS amp_masked, 0.5 AS std_dev, 0.5 AS amp_freq, 1 AS amp_numbers, accession
  FROM raw_ih_nt""",
    "file_ih_codons": """
  SELECT gff_feature, position_aa, ref_codon, alt_codon, ref_dp, alt_dp, alt_freq, '7;8' AS position_nt, 'A' AS ref_nt, 'C' AS alt_nt, accession FROM raw_ih_codons""",
    "file_demixed": """
  SELECT accession, lineage_name, input_order, abundance FROM
    (SELECT accession, lineage_name, abundance, row_number() OVER (PARTITION BY accession ORDER BY lineage_name, input_order) - 1 AS input_order
     FROM raw_abundances) AS q""",
    "file_scores": """
  SELECT position_aa, ref_aa, CASE WHEN id % 31 <> 0 THEN alt_aa END AS alt_aa, gff_feature,
         CASE WHEN id % 3 = 0 THEN 'n/a' ELSE cast(id % 100 AS string) END AS stability, cast(id % 7 AS string) AS escape FROM amino_acids""",
    # --- rows that break rules
    "odd_ranges": """
  SELECT DISTINCT change_id, freq_bin * 50 AS lo, (freq_bin + 1) * 50 + CASE WHEN sample_id % 40 = 0 THEN 20 ELSE 0 END AS hi,
         (freq_bin = 19 OR sample_id % 60 = 1) AS hi_closed FROM ih_edges""",
    "odd_edges": """
  SELECT parent_id, child_id FROM lineages_immediate_children
  UNION ALL SELECT 3000 + n_nationkey, 2000 + n_regionkey FROM nation WHERE n_nationkey % 6 = 1
  UNION ALL SELECT 1000 + n_nationkey, 2000 + n_regionkey FROM nation
  UNION ALL SELECT 10000 + s_suppkey, 10000 + s_suppkey FROM supplier WHERE s_suppkey % 10 = 0""",
    "odd_samples": """
  SELECT id, CASE WHEN id % 13 <> 0 THEN collection_start_date END AS collection_start_date,
         CASE WHEN id % 17 = 0 THEN collection_start_date - 1 ELSE collection_end_date END AS collection_end_date,
         is_retracted, CASE WHEN id % 100 <> 0 THEN retraction_detected_date END AS retraction_detected_date FROM samples""",
    "odd_calls": """
  SELECT sample_id, lineage_id, CASE WHEN sample_id % 101 = 0 THEN 0.5 ELSE abundance END AS abundance, is_consensus_call FROM samples_lineages
  UNION ALL SELECT sample_id, lineage_id, cast(NULL AS double), false FROM samples_lineages WHERE sample_id % 103 = 0""",
    "odd_amino_acids": """
  SELECT id, CASE WHEN id % 19 = 0 THEN '' ELSE gff_feature END AS gff_feature, ref_aa, alt_aa, ref_codon,
         CASE WHEN id % 23 = 0 THEN '' ELSE alt_codon END AS alt_codon FROM amino_acids""",
    "odd_values": """
  SELECT phenotype_metric_id, amino_acid_id + CASE WHEN amino_acid_id % 29 = 0 THEN 1000000000 ELSE 0 END AS amino_acid_id, value
  FROM phenotype_metric_values""",
}


def raw_frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return frame(spark, sf_dir, f"{with_clause(extra=RAW, only=name)}\nSELECT * FROM {name}")
