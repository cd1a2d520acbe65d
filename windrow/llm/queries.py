"""The registered queries of this subpackage: thin digests over the operators, whole tables in."""

from __future__ import annotations

import corpus_pipeline
from windrow.llm import chat, collocations, divergence
from windrow.llm.bpe import op7_bpe
from windrow.llm.chat import op12_chat
from windrow.llm.collocations import op11_phrases
from windrow.llm.common import table
from windrow.llm.decontaminate import op6_decontaminate
from windrow.llm.divergence import op13_divergence
from windrow.llm.fingerprint import op8_fingerprint
from windrow.llm.htmltext import op3_html
from windrow.llm.langid import op9_langid
from windrow.llm.simhash import op4_simhash
from windrow.llm.substring import op5_substring
from windrow.llm.toxicity import op1_toxicity
from windrow.llm.urlfilter import op10_urls
from windrow.llm.vocabulary import vocabulary
from windrow.llm.warc import op2_warc


QUERIES = {
    "op1_toxicity": lambda spark, d: op1_toxicity(table(spark, d, "documents"), table(spark, d, "labels")),
    "op2_warc": lambda spark, d: op2_warc(table(spark, d, "pages")),
    "op3_html": lambda spark, d: op3_html(table(spark, d, "pages")),
    "op4_simhash": lambda spark, d: op4_simhash(table(spark, d, "documents")),
    "op5_substring": lambda spark, d: op5_substring(table(spark, d, "documents")),
    "op6_decontaminate": lambda spark, d: op6_decontaminate(table(spark, d, "documents"), table(spark, d, "benchmark")),
    "op7_bpe": lambda spark, d: op7_bpe(table(spark, d, "documents"), vocabulary(spark)),
    "op8_fingerprint": lambda spark, d: op8_fingerprint(table(spark, d, "documents")),
    "op9_langid": lambda spark, d: op9_langid(table(spark, d, "documents")),
    "op10_urls": lambda spark, d: op10_urls(table(spark, d, "pages")),
    "op11_phrases": lambda spark, d: op11_phrases(table(spark, d, "documents")),
    "op12_chat": lambda spark, d: op12_chat(table(spark, d, "conversations")),
    "op13_divergence": lambda spark, d: op13_divergence(table(spark, d, "documents")),
    "pipeline": corpus_pipeline.run,
}

SQL: dict[str, str] = {"op11_phrases": collocations.SQL, "op12_chat": chat.SQL, "op13_divergence": divergence.SQL}
if corpus_pipeline.ORACLE_SQL:
    SQL["pipeline"] = corpus_pipeline.ORACLE_SQL
