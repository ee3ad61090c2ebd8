"""The corpus queries and their check SQL."""

from __future__ import annotations

from tessera.llm.brown import op1_brown
from tessera.llm.codes import OP11_SQL, op11_codes
from tessera.llm.heavylight import op3_heavy_light
from tessera.llm.leaks import op7_leaks
from tessera.llm.lines import op2_line_labels
from tessera.llm.mixing import OP8_SQL, op8_mixing
from tessera.llm.pii import op9_pii
from tessera.llm.rans import op5_rans
from tessera.llm.substrings import op10_substrings
from tessera.llm.suffix import op4_suffix_array
from tessera.llm.toxicity import op6_toxicity
from tessera.llm.variants import OP12_SQL, op12_variants
from tessera.llm.warc import OP13_SQL, op13_warc

# Where there is no SQL, the model, the format or the quadratic search can't be put in SQL on whole
# tables; tests/llm compares those with brute force on small tables.
QUERIES = {"op1_brown": op1_brown, "op2_line_labels": op2_line_labels,
           "op3_heavy_light": op3_heavy_light, "op4_suffix_array": op4_suffix_array,
           "op5_rans": op5_rans, "op6_toxicity": op6_toxicity, "op7_leaks": op7_leaks,
           "op8_mixing": op8_mixing, "op9_pii": op9_pii, "op10_substrings": op10_substrings,
           "op11_codes": op11_codes, "op12_variants": op12_variants,
           "op13_warc": op13_warc}
CHECKS = {"op8_mixing": OP8_SQL, "op11_codes": OP11_SQL, "op12_variants": OP12_SQL,
          "op13_warc": OP13_SQL}
