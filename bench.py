"""Wall-clock seconds of the headline queries, one JSON line."""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from clonoframe.plans import catalog  # noqa: E402
from clonoframe.session import session  # noqa: E402

HEADLINE = [
    "qc_filter", "freq_normalize", "reads_per_sample", "rarefy", "seq_properties", "kmer_counts",
    "motif_hits", "positional_aa", "charge_moments", "diversity", "powerlaw", "gini", "d50_d20",
    "charge_hydro", "usage_kl", "vj_pairing", "convergence", "group_convergence", "pairing",
    "len_hydro_moments", "bench_features", "basic_features", "enhanced_features", "multi_chain",
    "top_clones", "pool_build", "public_clonotypes", "pseudo_samples", "network_edges",
    "rank_test", "fisher_kmers", "domain_significance", "axis_corr", "centroid_shift",
    "roc_summary", "nearest_centroid", "sample_prototype_counts", "prototype_markers",
    "gene_enrichment", "kmer_enrichment", "known_match", "motif_pc1",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = session("bench")
    spark.sparkContext.setLogLevel("ERROR")
    catalog.QUERIES["chain_counts"](spark, sf_dir).collect()  # start the executors
    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "headline_query_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
