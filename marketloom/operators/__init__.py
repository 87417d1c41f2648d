"""DataFrame operators: cleaning, rules, merges, demand, features, forecasting, drift."""
