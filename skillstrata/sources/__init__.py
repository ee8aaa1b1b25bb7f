"""Files, lake layers, warehouse tables, relational sink."""
