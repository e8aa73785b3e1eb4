"""Reading tables and dumps, numbering rows, catalogs and stored results."""
