"""Jobs from relations to relations."""
