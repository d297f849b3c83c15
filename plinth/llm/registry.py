"""The queries of this subpackage and, where SQL can say it, the SQL that gives the same rows."""

from __future__ import annotations

from . import bpe, embeddings, fingerprint, lm, ngrams, packing, pii, quality, secrets, toxicity

QUERIES = {
    "op1_bpe": bpe.op1_bpe,
    "op2_ngrams": ngrams.op2_ngrams,
    "op3_packing": packing.op3_packing,
    "op4_embeddings": embeddings.op4_embeddings,
    "op5_lm": lm.op5_lm,
    "op6_secrets": secrets.op6_secrets,
    "op7_quality": quality.op7_quality,
    "op8_pii": pii.op8_pii,
    "op9_toxicity": toxicity.op9_toxicity,
    "op10_fingerprint": fingerprint.op10_fingerprint,
}

SQL: dict[str, str] = {"op4_embeddings": embeddings.OP4_SQL}
