from .readers import (
    read_delimited,
    read_matrix,
    read_matrix_json,
    read_meta,
    read_tree,
    read_tuples,
    read_vocab,
)
from .synthetic import gen_doc_topic, gen_waves

__all__ = [
    "gen_doc_topic", "gen_waves", "read_delimited", "read_matrix", "read_matrix_json", "read_meta",
    "read_tree", "read_tuples", "read_vocab",
]
