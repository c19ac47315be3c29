"""What results are written as."""
