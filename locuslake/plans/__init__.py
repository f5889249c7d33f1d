"""Row assembly plans and the registered queries."""
