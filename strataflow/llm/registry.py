"""Queries of this subpackage, for __spark_entry__.py."""

from __future__ import annotations

from . import bpe, collocations, hnsw, linededup, media, minhash, neighbours, packing, ppm, quality, sharding, toxicity

QUERIES = {f.__name__: f for f in (bpe.op1_bpe_round_trip, quality.op3_cotraining_quality, ppm.op4_ppm_scoring, media.op5_media_archives, toxicity.op6_nnpu_toxicity, packing.op7_pattern_packing, linededup.op2_line_winnowing, sharding.op8_flow_resharding, neighbours.op9_nn_descent, minhash.op10_circulant_minhash, hnsw.op11_hnsw, collocations.op12_collocations)}

#: DuckDB SQL for those that SQL can express.
ORACLES: dict[str, str] = {"op12_collocations": collocations.ORACLE}
