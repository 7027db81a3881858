"""Analytics over raters' scores of items, as lazy DataFrame operators.

The canonical relation is ``ratings(user_id, item_id, prediction, label)``: a rater (say, a base classifier and its bag,
``name.bag``), an item, the rater's score, and the item's 0/1 label.
"""
