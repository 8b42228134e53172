"""The layers of the warehouse: entity specs, silver, star schema, KPIs and batch jobs."""
