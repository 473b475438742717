"""The queries of the numbered operators, and their SQL where SQL can express them."""

from .centroids import OP12_SQL, op12_centroids
from .decontamination import OP3_SQL, op3_decontamination
from .jaccard import OP7_SQL, op7_jaccard
from .jpeg import op2_media
from .mixing import op9_mixing
from .mixing_lm import op10_lm
from .quality import op4_quality
from .simhash import op11_simhash
from .substrings import OP8_SQL, op8_substrings
from .suffixes import OP1_SQL, op1_suffixes
from .token_files import op5_token_files
from .toxicity import op6_toxicity
from .vector_codes import OP13_SQL, op13_vector_codes

QUERIES = {f.__name__: f for f in (op1_suffixes, op2_media, op3_decontamination, op4_quality, op5_token_files, op6_toxicity, op7_jaccard, op8_substrings, op9_mixing, op10_lm, op11_simhash, op12_centroids, op13_vector_codes)}
ORACLE_SQL: dict[str, str] = {"op1_suffixes": OP1_SQL, "op3_decontamination": OP3_SQL, "op7_jaccard": OP7_SQL, "op8_substrings": OP8_SQL, "op12_centroids": OP12_SQL, "op13_vector_codes": OP13_SQL}
