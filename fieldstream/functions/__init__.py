"""Functions of columns: time, rules, documents."""
