"""Column expressions; all of them stay in the JVM."""

from stancewright.functions.arrays import (
    argmax,
    nan_to_null,
    sigmoid,
    softmax,
    threshold,
    to_vector,
    top_probability,
)
from stancewright.functions.dates import COMMON_FORMATS, day_first, formats_of, month_of, parse_date
from stancewright.functions.text import (
    last_segment,
    percent_text,
    polarity_text,
    score_mean,
    score_spread,
    sequence_code,
    stance_name,
)

__all__ = [
    "COMMON_FORMATS", "argmax", "day_first", "formats_of", "last_segment", "month_of", "nan_to_null",
    "parse_date", "percent_text", "polarity_text", "score_mean", "score_spread", "sequence_code", "sigmoid", "softmax",
    "stance_name", "threshold", "to_vector", "top_probability",
]
