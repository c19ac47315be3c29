"""Where rows come from: tables, JSON documents, paged features, coverages; and how they stand for terms."""
