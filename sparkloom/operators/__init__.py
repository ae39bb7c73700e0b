"""Operators: functions from DataFrames and Columns to DataFrames."""

from .actions import cancel, cancellable, count, first, fold, for_each, for_each_partition, is_empty, max_of, min_of, observed, reduce, take, task_info, tree_aggregate
from .joins import broadcast_lookup, cartesian, cogroup, full_join, join, left_join, lookup, right_join, subtract_by_key
from .keyed import aggregate_by_key, combine_by_key, count_by_key, count_by_value, fold_by_key, group_by_key, reduce_by_key
from .narrow import filter_rows, flat_map, flat_map_values, glom, key_by, keys, map_partitions, map_partitions_with_index, map_rows, map_values, pipe, random_split, sample, values
from .partitioning import coalesce, partition_by, repartition, repartition_by_range
from .positional import zip_frames, zip_partitions, zip_with_index
from .sets import distinct, intersection, subtract, union
from .sorting import sort_by_key

__all__ = [
    "aggregate_by_key", "broadcast_lookup", "cancel", "cancellable", "cartesian", "coalesce", "cogroup", "combine_by_key", "count", "count_by_key", "count_by_value", "distinct", "filter_rows",
    "first", "flat_map", "for_each", "for_each_partition", "flat_map_values", "fold", "fold_by_key", "full_join", "glom", "group_by_key", "intersection", "is_empty", "join", "key_by", "keys", "left_join",
    "lookup", "map_partitions", "map_partitions_with_index", "map_rows", "map_values", "max_of", "min_of", "observed", "partition_by", "pipe", "random_split", "reduce", "reduce_by_key",
    "repartition", "repartition_by_range", "right_join", "sample", "sort_by_key", "subtract", "subtract_by_key", "take", "task_info", "tree_aggregate", "union", "values", "zip_frames",
    "zip_partitions", "zip_with_index",
]
