"""DataFrame -> DataFrame operators on panels (entity x period)."""
