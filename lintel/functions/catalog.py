"""The operators of the expression language: signatures, flags, and how text names them.

A signature lists parameter patterns and a result. A pattern is a type word, a variable such as T,
a variable with a class such as T:Ordered, list(..), map(..), or any of these with ? behind it for
a parameter that sees nulls. A parameter after a semicolon may be left out.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import cached_property

# Ids, signatures and flags of the operators, one a line.
#   short: decides by one side; consume: handles null operands itself; error: may fail on values;
#   now: reads the clock; swap: operands may change places.
OPERATORS = """
logical_or          bool?, bool? -> bool                        short consume swap
logical_and         bool?, bool? -> bool                        short consume swap
logical_not         bool -> bool
and_not             bool?, bool? -> bool                        short consume
xor                 bool, bool -> bool                          swap
equal               T:Comparable, T -> bool                     swap
not_equal           T:Comparable, T -> bool                     swap
less_than           T:Ordered, T -> bool
less_or_equal       T:Ordered, T -> bool
greater_than        T:Ordered, T -> bool
greater_or_equal    T:Ordered, T -> bool
between             T:Ordered, T, T -> bool
null_safe_equal     T:Comparable?, T? -> bool                   consume swap
null_safe_not_equal T:Comparable?, T? -> bool                   consume swap
is_null             T? -> bool                                  consume
is_not_null         T? -> bool                                  consume
is_nan              double -> bool
is_finite           double -> bool
is_infinite         double -> bool
coalesce            T?, T? -> T                                 consume
try_or_else         T?, T? -> T                                 consume
raise_error         string -> bottom                            error
least               T:Ordered, T -> T
greatest            T:Ordered, T -> T
add                 T:Summable, T -> T                          error swap
subtract            T:Summable, T -> T                          error
multiply            T:Numeric, T -> T                           error swap
divide              T:Numeric, T -> T                           error
modulus             T:Numeric, T -> T                           error
negate              T:Numeric -> T                              error
abs                 T:Numeric -> T                              error
power               T:Numeric, T -> T                           error
sqrt                double -> double
exp                 double -> double
sign                T:Numeric -> T
ln                  double -> double
log10               double -> double
ceil                double -> double
floor               double -> double
round               double -> double
duration_multiply   duration, int -> duration                   error
contains            string, string -> bool
starts_with         string, string -> bool
ends_with           string, string -> bool
regex_match         string, string -> bool
regex_extract       string, string -> string
regex_replace       string, string, string -> string
url_path_segment    string, int; string? -> string
url_query_param     string, string; string? -> string
size                T:Sizable -> int
lower               string -> string
upper               string -> string
substring           string, int, int -> string
replace             string, string, string -> string
trim                string -> string
ltrim               string -> string
rtrim               string -> string
left                string, int -> string
right               string, int -> string
string_split        string, string -> list(string)
regexp_string_split string, string -> list(string)
regexp_match_all    string, string -> list(string)
regexp_strpos       string, string -> int
regexp_count_substring string, string -> int
count_substring     string, string -> int
string_position     string, string -> int
concat              string, string -> string
concat_ws           string, string?, string? -> string          consume
timestamp_extract   timestamp, string -> int
round_temporal      timestamp, string -> timestamp
round_calendar      timestamp, string -> timestamp
assume_timezone     timestamp, string -> timestamp
current_timestamp   -> timestamp                                now
datetime_format     timestamp, string -> string
datetime_parse      string; string -> timestamp                 error
cast_bool           T:Castable -> bool                          error
cast_int            T:Castable -> int                           error
cast_uint           T:Castable -> uint                          error
cast_double         T:Castable -> double                        error
cast_string         T:Castable -> string
cast_bytes          T:Castable -> bytes
cast_duration       T:Castable -> duration                      error
cast_timestamp      T:Castable -> timestamp                     error
type_of             T? -> type                                  consume
dyn                 T? -> T                                     consume
conditional         bool?, T?, T? -> T                          short consume
index               list(T), int -> T                           error
in                  T, list(T) -> bool
list_sort           list(T:Ordered) -> list(T)
list_cardinality    T:Sizable -> int
has                 T? -> bool                                  consume
json_parse          string -> any                               error
json_parse_struct   string, string -> any                       error
json_stringify      T -> string
json_extract        string, string -> any
json_extract_string string, string -> string
cidr_contains       string, string -> bool
cidr_match          string, list(string) -> bool
ip_to_int           string -> int
int_to_ip           int -> string
is_true             bool? -> bool                               consume
is_not_true         bool? -> bool                               consume
is_false            bool? -> bool                               consume
is_not_false        bool? -> bool                               consume
nullif              T:Comparable?, T? -> T                      consume
least_skip_null     T:Ordered?, T? -> T                         consume
greatest_skip_null  T:Ordered?, T? -> T                         consume
factorial           int -> int                                  error
sin                 double -> double
cos                 double -> double
tan                 double -> double
asin                double -> double
acos                double -> double
atan                double -> double
atan2               double, double -> double
sinh                double -> double
cosh                double -> double
tanh                double -> double
asinh               double -> double
acosh               double -> double
atanh               double -> double
radians             double -> double
degrees             double -> double
bitwise_not         T:Signed -> T
bitwise_and         T:Signed, T -> T                            swap
bitwise_or          T:Signed, T -> T                            swap
bitwise_xor         T:Signed, T -> T                            swap
shift_left          int, int -> int
shift_right         int, int -> int
shift_right_unsigned int, int -> int
log2                double -> double
logb                double, double -> double
log1p               double -> double
like                string, string -> bool
repeat              string, int -> string
reverse             string -> string
replace_slice       string, int, int, string -> string
swapcase            string -> string
capitalize          string -> string
title               string -> string
initcap             string -> string
bit_length          string -> int
lpad                string, int; string -> string
rpad                string, int; string -> string
center              string, int; string -> string
extract_boolean     timestamp, string -> bool
strptime_date       string, string -> date                      error
strptime_time       string, string -> duration                  error
"""

# Quantifiers and comprehensions.
COMPREHENSIONS = ("all", "exists", "exists_one", "filter", "map_transform")

# How text names operators.
INFIX = {"||": "logical_or", "&&": "logical_and", "==": "equal", "!=": "not_equal", "<": "less_than", "<=": "less_or_equal", ">": "greater_than", ">=": "greater_or_equal", "in": "in", "+": "add", "-": "subtract", "*": "multiply", "/": "divide", "%": "modulus"}
METHODS = {"contains": "contains", "startsWith": "starts_with", "endsWith": "ends_with", "matches": "regex_match", "size": "size"}
FUNCTIONS = {"size": "size", "bool": "cast_bool", "int": "cast_int", "uint": "cast_uint", "double": "cast_double", "string": "cast_string", "bytes": "cast_bytes", "duration": "cast_duration", "timestamp": "cast_timestamp", "type": "type_of", "dyn": "dyn", "has": "has"}
MACROS = {"all": "all", "exists": "exists", "exists_one": "exists_one", "filter": "filter", "map": "map_transform"}
#: Accessors of timestamps; those of months and days count from 0, but for getDate.
ACCESSORS = ("getFullYear", "getMonth", "getDate", "getDayOfMonth", "getDayOfWeek", "getDayOfYear", "getHours", "getMinutes", "getSeconds", "getMilliseconds")


@dataclass(frozen=True)
class Operator:
    id: str
    params: tuple[str, ...]
    optional: int
    result: str
    flags: frozenset[str]

    @property
    def least(self) -> int:
        return len(self.params) - self.optional

    @cached_property
    def sees_null(self) -> tuple[bool, ...]:
        return tuple(p.endswith("?") for p in self.params)


def parse(table: str) -> dict[str, Operator]:
    out = {}
    for line in filter(None, map(str.strip, table.splitlines())):
        head, result = line.split("->")
        name, _, params = head.strip().partition(" ")
        result, *flags = result.split()
        needed, _, optional = params.partition(";")
        split = lambda s: tuple(x.strip() for x in re.split(r",(?![^(]*\))", s) if x.strip())
        out[name] = Operator(name, split(needed) + split(optional), len(split(optional)), result, frozenset(flags))
    return out


CATALOG = parse(OPERATORS)
