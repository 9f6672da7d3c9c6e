"""Plans: the reduction of many bundles from items to verdicts, and the recipes that feed the queries."""
