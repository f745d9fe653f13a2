from tessera.functions.expr import (
    all_of,
    any_of,
    cast_to,
    constant,
    date_shift,
    epoch_day,
    in_list,
    int_div,
    like_tokens,
    not_like_tokens,
    with_constant,
)

__all__ = [
    "all_of",
    "any_of",
    "cast_to",
    "constant",
    "date_shift",
    "epoch_day",
    "in_list",
    "int_div",
    "like_tokens",
    "not_like_tokens",
    "with_constant",
]
