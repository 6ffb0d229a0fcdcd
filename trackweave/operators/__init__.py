"""DataFrame operators: fusion, gates, filters, alerts, history, changelogs."""
