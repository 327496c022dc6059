"""DataFrame-to-DataFrame operators, each one a lazy plan over many tables and loads at once."""
