"""Named queries and the SQL that checks them."""

from . import composed, datasets, entities, fields, generic, grids, keyed, layers, parsing, reports, stages, standing, whole
from .catalogue import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "composed", "datasets", "entities", "fields", "generic", "grids", "keyed", "layers", "parsing", "reports", "stages", "standing", "whole"]
