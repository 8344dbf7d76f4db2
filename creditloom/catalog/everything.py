"""All registered queries in one catalog."""

from __future__ import annotations

from creditloom.catalog import columns, features, models, profiles
from creditloom.catalog.kit import Catalog

catalog = Catalog().merge(features.catalog, columns.catalog, profiles.catalog, models.catalog)
