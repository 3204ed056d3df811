"""Reading corpora, collected pages and index artifacts; writing them."""
